import json

import pytest
from pyspark.sql import functions as F

from gritsieve.operators.quality import error_report
from gritsieve.schema import MOVIE_COLUMNS, SemanticSchema
from gritsieve.session import ensure_checkpoint_dir
from gritsieve.sources import files
from gritsieve.streaming import typed

CSV = '''id,"title, long",note
1,"two
lines","say ""hi"""
NA,None,null
2,"",x
'''


def test_read_text_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(CSV)
    assert files.csv_column_names(spark, str(path)) == ["id", "title, long", "note"]
    found = [tuple(r) for r in files.read_text_csv(spark, str(path)).collect()]
    assert found == [("1", "two\nlines", 'say "hi"'), (None, None, None), ("2", None, "x")]
    typed_rows = files.read_text_csv(spark, str(path), SemanticSchema({"id": "integer", "title": "string", "note": "string"}).text_struct())
    assert typed_rows.schema["id"].metadata == {"semantic_type": "integer"} and typed_rows.count() == 3


def test_write_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\n\"b\"", [1, 2]), (2, None, None), (3, "c,\\d", [])], "id int, t string, l array<int>")
    path = str(tmp_path / "out")
    files.write_csv(df, path)
    found = {r["id"]: (r["t"], r["l"]) for r in files.read_text_csv(spark, path).collect()}
    assert found == {"1": ("a\n\"b\"", "[1,2]"), "2": (None, None), "3": ("c,\\d", "[]")}


def test_inferred_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("a,b\n1,2.5\n3,NaN\n")
    found = files.read_inferred_csv(spark, str(path))
    assert found.dtypes == [("a", "int"), ("b", "double")] and found.where("b is null").count() == 1


def test_report_tables(spark, tmp_path):
    df = spark.createDataFrame([("x", "t"), ("1", " ")], "id string, title string")
    files.write_report(error_report(df, MOVIE_COLUMNS, "r"), str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report" / "rejects")).count() == 2


def test_sample_rows(spark):
    df = spark.range(100)
    first = [r[0] for r in files.sample_rows(df, 7, ["id"]).collect()]
    assert len(set(first)) == 7 and first == [r[0] for r in files.sample_rows(df, 7, ["id"]).collect()]
    assert first != [r[0] for r in files.sample_rows(df, 7, ["id"], seed=1).collect()]
    assert files.sample_rows(df, 500, ["id"]).count() == 100


def test_typed_stream(spark, tmp_path):
    schema = SemanticSchema({"id": "integer", "flag": "boolean", "tags": "list_of_dict"})
    source = tmp_path / "in"
    source.mkdir()
    rows = [{"n": 1, "id": "5", "flag": "True", "tags": "[{'a': 1}]"}, {"n": 2, "id": "x", "flag": "no", "tags": "[]"}]
    (source / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("n bigint, id string, flag string, tags string").json(str(source))
    for name, part in (("typed", typed.typed_stream(stream, schema)), ("rejects", typed.rejects_stream(stream, schema, "n"))):
        query = typed.write_stream(part, str(tmp_path / name), str(tmp_path / f"{name}-log"))
        query.awaitTermination(60)
    found = spark.read.parquet(str(tmp_path / "typed")).orderBy("n").collect()
    assert [(r["n"], r["id"], r["flag"], r["tags"]) for r in found] == [(1, 5, True, [{"a": "1"}]), (2, None, None, None)]
    assert {r["column"] for r in spark.read.parquet(str(tmp_path / "rejects")).collect()} == {"id", "flag", "tags"}


def test_checkpoint_folder(spark):
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir()
    assert spark.range(3).checkpoint().agg(F.sum("id")).first()[0] == 3


def test_pushdown_and_pruning(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10).selectExpr("id AS a", "cast(id AS string) AS b", "id * 2 AS c").write.parquet(path)
    from gritsieve.operators.scaling import standard_scale

    plan = standard_scale(spark.read.parquet(path).where("a > 3").select("c"), ["c"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:bigint,c:bigint>" in plan and "GreaterThan(a,3)" in plan
