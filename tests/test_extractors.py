import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gritsieve.functions import nested, scalars, text
from gritsieve.operators.quality import columns_within, detect_types
from gritsieve.schema import (
    MOVIE_COLUMNS,
    SemanticSchema,
    extract_columns,
    register_type,
    semantic_type,
    verify_column_names,
)


@pytest.fixture(autouse=True)
def text_column(spark):
    """The column all cases read; it needs a running session."""
    global c
    c = F.col("c")


def values(spark, inputs, column):
    rows = spark.createDataFrame(list(enumerate(inputs)), "i int, c string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_strings(spark):
    inputs = ["  [{'id': 16, 'name': 'le'Animation3'}]  ", "   ", "", None, "  x\x1f\n", "a b"]
    found = values(spark, inputs, text.extract_string(c))
    assert found == ["[{'id': 16, 'name': 'le'Animation3'}]", None, None, None, "x", "a b"]
    assert found == [s.strip() or None if s else None for s in inputs]


def test_integers(spark):
    inputs = ["123", "123.14", "123E-10", "  ", "123.00000", "123.0456", " 5 ", " 5.0 ", "-3", "007", None, "99999999999999999999"]
    assert values(spark, inputs, scalars.extract_integer(c)) == [123, None, None, None, 123, None, 5, 5, None, 7, None, None]
    assert values(spark, ["-3", "+4.0", "x"], scalars.extract_integer(c, signed=True)) == [-3, 4, None]


def test_floats(spark):
    inputs = ["3.14", "3.14.14", "3.14E-10", "8.387519", "-1.", ".5", "inf", "-Infinity", "nan", "1.0d", "1f", "0x1p3", "", None]
    expected = [3.14, None, 3.14e-10, 8.387519, -1.0, 0.5, math.inf, -math.inf, None, None, None, None, None, None]
    assert values(spark, inputs, scalars.extract_float(c)) == expected


def test_booleans(spark):
    inputs = ["True", "False", "Falsee", None, "  ", " tRUE ", "t", "yes", "1"]
    assert values(spark, inputs, scalars.extract_boolean(c)) == [True, False, None, None, None, True, None, None, None]
    assert values(spark, inputs, scalars.is_boolean(c, exact=True)) == [True, True] + [False] * 7


def test_dates(spark):
    inputs = ["2022-10-11", "2022-10-1", "2022-10-11T14:14:14.123=06:00", " 2022-10-11 ", "2023-02-30", "1677-09-21", "1677-09-22", "2262-04-12", None, "2022-10-11\n"]
    day = dt.date(2022, 10, 11)
    assert values(spark, inputs, scalars.extract_date(c)) == [day, None, None, day, None, None, dt.date(1677, 9, 22), None, None, day]


def test_datetime_texts(spark):
    inputs = ["2022-10-11", "2024-11-03", "24-12-01", None, "", "2024-11-03T14:14:14.123=06:00", "2024-10-03T18:32:08 UTC"]
    assert values(spark, inputs, scalars.is_datetime_text(c)) == [True, True, False, False, False, False, False]


def test_categories(spark):
    inputs = ["Released", " Post Production ", "released", "Gone", None]
    assert values(spark, inputs, scalars.extract_category(c)) == ["Released", "Post Production", None, None, None]


def test_dicts(spark):
    inputs = ["{'id': 16, 'name': 'Animation5'}", r"{'id': 16, 'name': 'le\'Animation6'}", "{}", "[]", "0.065736", "{'a': {'b': [1, None]}}", "{'a': 1} junk", '"', '""', None, "{[]: 1}"]
    assert values(spark, inputs, nested.extract_dict(c)) == [
        {"id": "16", "name": "Animation5"}, {"id": "16", "name": "le'Animation6"}, {}, None, None,
        {"a": '{"b":[1,null]}'}, None, None, None, None, None,
    ]


def test_records(spark):
    inputs = [
        "[{'id': 16, 'name': 'le'Animation1'}, {'id': 17, 'name': 'Action'}]",
        "[{'id': 1, 'name': 'A'}, {'id': 2, 'name': 'B'}, {'id': 3, 'name': 'C'}]",
        "[{'id': 16, 'name': 'AnimationB'}, [1,2], 3]",
        "[]",
        "[{}]",
        "[null]",
        "{'id': 1}",
        "False",
        "6.0",
        """[{'name': 'The Booking Office', 'id': 12909}, {'name': "Workin' Man Films", 'id': 12910}]""",
        """[{'name': 'A "Tor" B', 'id': 1}]""",
        r"[{'iso_639_1': 'lt', 'name': 'Lietuvi\x9akai'}]",
        "[{'name': None, 'ok': True}]",
        "[{'id': 1}] // c",
        '[{"id": 1}],"v":[{"id": 2}]',
        None,
    ]
    assert values(spark, inputs, nested.extract_records(c)) == [
        [{"id": "16", "name": "le'Animation1"}, {"id": "17", "name": "Action"}],
        [{"id": "1", "name": "A"}, {"id": "2", "name": "B"}, {"id": "3", "name": "C"}],
        None, None, [{}], None, None, None, None,
        [{"name": "The Booking Office", "id": "12909"}, {"name": "Workin' Man Films", "id": "12910"}],
        [{"name": 'A "Tor" B', "id": "1"}],
        [{"iso_639_1": "lt", "name": "Lietuvi\x9akai"}],
        [{"name": None, "ok": "true"}],
        None, None, None,
    ]


def test_objects_and_fallback(spark):
    inputs = ["[{'a': 1,}]", r"{'a': '\101'}", "[1, 2]", "'abc'", "3", "(1, 2)", "{[]: 1}", "[", None]
    assert values(spark, inputs, nested.extract_object(c)) == ['[{"a":1}]', None, "[1,2]"] + [None] * 6
    assert values(spark, inputs, nested.extract_object(c, python_fallback=True)) == ['[{"a":1}]', '{"a": "A"}', "[1,2]"] + [None] * 6
    assert values(spark, inputs, nested.extract_records(c, python_fallback=True))[0] == [{"a": "1"}]
    assert values(spark, ["[1]", "{'a': 1}", "x"], nested.object_kind(c)) == ["array", "object", None]
    assert values(spark, ["[]", "[1, 'x']", "{}", None], nested.list_length(c)) == [0, 2, None, None]
    assert values(spark, ["[]", "[1, 'x', {'a': 2}]"], nested.list_elements(c)) == [[], ["1", "x", '{"a":2}']]


def test_typed_records(spark):
    found = values(spark, ["[{'id': 1, 'name': 'A'}, {'id': 'x', 'name': 'B'}]"], nested.typed_records(c, {"id": "bigint", "name": "string"}))
    assert [tuple(r) for r in found[0]] == [(1, "A"), (None, "B")]


def test_long_blank_runs_are_linear(spark):
    long = "x" + " " * 200_000 + "y"
    assert values(spark, [long], F.length(text.strip(c))) == [200_002]


def test_movie_schema(spark):
    assert MOVIE_COLUMNS.column_type("genres") == "list_of_dict"
    assert MOVIE_COLUMNS.column_dtype("release_date") == "date"
    with pytest.raises(ValueError):
        MOVIE_COLUMNS.column_type("nope")
    with pytest.raises(ValueError):
        semantic_type("nope")
    df = spark.createDataFrame([("1", "x", "2.5")], "id string, title string, popularity string")
    assert MOVIE_COLUMNS.numeric_columns(df) == ["id", "popularity"]
    typed = extract_columns(df, MOVIE_COLUMNS)
    assert typed.dtypes == [("id", "bigint"), ("title", "string"), ("popularity", "double")]
    assert MOVIE_COLUMNS.text_struct()["id"].metadata == {"semantic_type": "integer"}


def test_verify_column_names():
    verify_column_names(["a", "b"], ["b", "a"])
    verify_column_names([], [])
    for actual, told in (
        (["a"], r"1 missing \(b\)$"),
        (["b", "c", "a"], r"^column names: 1 unexpected \(c\)$"),
        (["a", "d", "c"], r"1 missing \(b\); 2 unexpected \(c, d\)"),
        (["a", "b", "b"], r"^column names: 1 repeated \(b\)$"),
    ):
        with pytest.raises(ValueError, match=told):
            verify_column_names(["a", "b"], actual)


def test_detected_booleans(spark):
    rows = [("True", "True", "True", "True"), ("a", "False", None, "False"), ("False", "False", "True", "")]
    df = spark.createDataFrame(rows, "text string, video string, other string, other2 string")
    found = {(r["column"], r["semantic_type"]): r["fits"] for r in detect_types(df, ["boolean", "string"]).collect()}
    assert [n for n in df.columns if found[n, "boolean"]] == ["video", "other"]
    within = {r["column"]: r["fits"] for r in columns_within(df, ["True", "False"], skip=["text"]).collect()}
    assert within == {"video": True, "other": True, "other2": False}


def test_registered_type(spark):
    register_type("even", lambda x: F.when(x.try_cast("int") % 2 == 0, x.try_cast("int")), "int", numeric=True)
    schema = SemanticSchema({"c": "even"})
    assert values(spark, ["2", "3"], schema.extractor("c")(c)) == [2, None]


def test_literals_keep_quoted_words_and_the_last_of_equal_keys(spark):
    c = F.col("c")
    texts = [
        "{'id': 1, 'id': 2}", "{'n': 'Yes, None, All'}", "{'name': 'a: True, b'}", "{1: 'a'}", "{'a': 'b',}", "{'n': 'it''s'}",
        "{'a': None, 'b': 'None', 'c': True}", "{'n': 'le'Set', 'None': None}",
    ]
    want = [
        {"id": "2"}, {"n": "Yes, None, All"}, {"name": "a: True, b"}, {"1": "a"}, {"a": "b"}, {"n": "its"},
        {"a": None, "b": "None", "c": "true"}, {"n": "le'Set", "None": None},
    ]
    assert values(spark, texts, nested.extract_dict(c)) == want
    assert values(spark, ["[{'id': 1,}]", "[{'id': 1, 'id': 3}, {'n': 'x, True'}]"], nested.extract_records(c)) == [[{"id": "1"}], [{"id": "3"}, {"n": "x, True"}]]
