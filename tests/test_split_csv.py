"""The split CSV reader against Spark's whole-file reader, at many range sizes."""

import random

import pytest
from pyspark.sql import functions as F

from gritsieve.operators.duplicates import drop_exact_duplicates, find_duplicates
from gritsieve.sources import files, split_csv

TRICKY = [
    'a,"b\nc",d',
    '1,"say ""hi""\n""\n",x',
    ',,',
    '5" pipe,plain,"q"',
    '"",""" ""","\n\n\n"',
    '"x,y\n,""z""",2,3',
    "été,ü,日本",
    '"long ' + "line\n" * 40 + '",1,2',
]


def content(rows=400, seed=1, ending="\n"):
    rng = random.Random(seed)
    return ending.join(['id,"two\nlines",c', *(rng.choice(TRICKY) for _ in range(rows))]) + ending


@pytest.fixture
def ranges(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield use
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_equals_the_whole_file_reader_at_every_range_size(spark, tmp_path, ranges):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.csv").write_text(content())
    (tmp_path / "in" / "a.csv").write_text(content(150, 2))
    (tmp_path / "in" / "c.csv").write_text('id,"two\nlines",c\n')
    path = str(tmp_path / "in")
    whole = files.read_text_csv(spark, path, whole_files=True)
    want = sorted(map(str, whole.collect()))
    numbered = None
    for size in (64, 777, 4096, 1 << 27):
        ranges(size)
        split = files.read_text_csv(spark, path, whole.schema, number="at")
        assert split.columns == ["id", "two\nlines", "c", "at"]
        rows = sorted(split.collect(), key=lambda r: r["at"])
        assert [r["at"] for r in rows] == list(range(550))
        assert sorted(str(r) for r in split.drop("at").collect()) == want
        numbered = numbered or rows
        assert rows == numbered  # the numbers do not depend on the ranges
        if size == 777:
            assert split_csv._lines(spark, path).rdd.getNumPartitions() > 20
            assert "MapInArrow" in split._jdf.queryExecution().executedPlan().toString()
    one = files.read_text_csv(spark, f"{path}/a.csv", whole.schema, whole_files=True).collect()
    assert [tuple(r)[:3] for r in numbered[:150]] == [tuple(r) for r in one]  # in the file's own order


def test_carriage_returns_empty_lines_and_open_quotes(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes(b'a,b\r\n1,"x\r\ny"\r\n\r\n2,z')
    rows = files.read_text_csv(spark, str(path), number="n").orderBy("n").collect()
    assert [tuple(r) for r in rows] == [("1", "x\r\ny", 0), ("2", "z", 2)]
    path.write_text('a,b\n1,"never closed\n2,3\n')
    assert files.read_text_csv(spark, str(path)).count() == 1
    path.write_text("a,b\n")
    assert files.read_text_csv(spark, str(path)).collect() == []


@pytest.mark.parametrize(
    "line, inside, leaves",
    [("", False, False), ("", True, True), ('a"b,c', False, False), ('"a', False, True), ('a"', True, False), ('""', True, True), ('"","', False, True), ('x""y"z,"', True, True), ('"a"b,"c"', False, False)],
)
def test_states(line, inside, leaves):
    assert split_csv.leaves_inside(line, inside) is leaves


def test_numbers_take_the_place_of_an_order_column(spark, tmp_path, ranges):
    path = tmp_path / "in.csv"
    path.write_text("id,t\n" + "".join(f'{i % 7},"v\n{i % 7}"\n' for i in range(60)))
    ranges(50)
    rows = files.read_text_csv(spark, str(path), number="row")
    found = find_duplicates(rows, "row", ("id", "t")).orderBy("row").collect()
    assert [(r["row"], r["count"]) for r in found] == [(i, 9 if i < 4 else 8) for i in range(7)]
    kept = drop_exact_duplicates(rows, "row", ["id", "t"])
    assert sorted(r["row"] for r in kept.collect()) == list(range(7))


def test_numbers_of_a_parquet_table(spark, tmp_path, ranges):
    spark.range(500).repartition(3).write.option("parquet.block.size", "1").parquet(str(tmp_path / "t.parquet"))
    seen = set()
    for size in (100, 2000, 1 << 27):
        ranges(size)
        rows = files.read_numbered_table(spark, str(tmp_path), "t", "n").collect()
        assert sorted(r["n"] for r in rows) == list(range(500))
        seen.add(tuple(sorted((r["n"], r["id"]) for r in rows)))
    assert len(seen) == 1
