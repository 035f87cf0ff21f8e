"""The SQL functions against the column expressions they stand for."""

import pytest
from pyspark.sql import functions as F

from gritsieve.functions import nested, scalars, text
from gritsieve.functions.sql import register_functions

TEXTS = [
    None, "", " \t ", "  x 　", "12", " 12.00 ", "12.5", "x12", "1e5", "-.5", "nan", "inf", "True", " false ", "Falsee", "2020-01-02", " 2021-05-06\n",
    "2023-02-30", "1600-01-01", "Released", " Rumored", "released", "[]", "{}", "[1, 'x', {'a': None}]", "[{'id': 1, 'name': None}, {'id': 2, 'name': 'a'}]",
    "[{'id': 16, 'name': 'le'Show'}]", "{'a': 1, 'a': 2, 'b': True}", '[{"a": "None, \\"x\\""},]', "{1: 'a', 2.5: 'b'}", "[{'a': 'x\\x9ay'}]", "[{'a': 'b''c'}]", "[{'a': 1}, 3]", "[{'a': 1}] junk", "'abc'",
]


@pytest.fixture(scope="module")
def view(spark):
    register_functions(spark)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, s string")
    df.createOrReplaceTempView("texts")
    return df


@pytest.mark.parametrize(
    "name, extract",
    [
        ("extract_string", text.extract_string), ("extract_integer", scalars.extract_integer), ("extract_float", scalars.extract_float),
        ("extract_boolean", scalars.extract_boolean), ("extract_ymd_datetime", scalars.extract_date), ("extract_status_category", scalars.extract_category),
        ("extract_dict", nested.extract_dict), ("extract_list_of_dict", nested.extract_records), ("extract_object", nested.extract_object),
        ("list_elements", nested.list_elements), ("to_amount", scalars.to_numeric),
    ],
)
def test_function_equals_its_column(spark, view, name, extract):
    want = {r["i"]: r["v"] for r in view.select("i", extract(F.col("s")).alias("v")).collect()}
    assert {r["i"]: r["v"] for r in spark.sql(f"SELECT i, {name}(s) AS v FROM texts").collect()} == want


def test_table_functions(spark, view):
    items = spark.sql("SELECT i, item FROM texts, LATERAL list_items(s)")
    want = view.select("i", F.explode(nested.list_elements(F.col("s"))).alias("item"))
    assert sorted(map(tuple, items.collect())) == sorted(map(tuple, want.collect()))
    records = spark.sql("SELECT i, record['id'] AS id FROM texts, LATERAL list_records(s) WHERE record['id'] IS NOT NULL")
    assert sorted(map(tuple, records.collect())) == [(25, "1"), (25, "2"), (26, "16")]


def test_questions_in_sql_run_no_python(spark):
    import __spark_entry__ as entry_module

    for name in ("qry_3_sql", "qry_5_sql"):
        plan = entry_module.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
