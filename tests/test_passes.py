"""How often cells are judged and tables derived."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gritsieve import schema as schemas
from gritsieve.functions import nested
from gritsieve.llm import collocations
from gritsieve.operators import quality
from gritsieve.operators.profile import text_profile
from gritsieve.plans.cleaning import clean
from gritsieve.schema import SemanticSchema, SemanticType
from gritsieve.sources.files import write_report
from gritsieve.streaming import validation


def counted(spark, f):
    """A Python function of a text and the number of its calls with one."""
    calls = spark.sparkContext.accumulator(0)

    def run(text):
        if text is None:
            return None
        calls.add(1)
        return f(text)

    return F.udf(run, "string"), calls


def counted_type(spark, monkeypatch):
    """A type whose valid cells are the texts of digits, and the number of cells it has judged."""
    digits, calls = counted(spark, lambda t: t if t.isdigit() else None)
    monkeypatch.setitem(schemas._REGISTRY, "digits", SemanticType("digits", digits, "string"))
    return SemanticSchema({"a": "digits"}), calls


def rows_of(spark, texts, times=20):
    return spark.createDataFrame([(t,) for t in texts] * times, "a string").repartition(1)


def test_stream_batch_is_dealt_to_all_tasks(spark, monkeypatch, tmp_path):
    parts = []
    monkeypatch.setattr(validation, "distinct_rejects", lambda df, s: parts.append(df.rdd.getNumPartitions()) or quality.distinct_rejects(df, s))
    validation.write_batch(rows_of(spark, ["1", "x"]), 0, str(tmp_path), SemanticSchema({"a": "integer"}))
    assert parts == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
    assert list(map(tuple, validation.running_rejects(spark, str(tmp_path)).collect())) == [("a", "integer", "x", 20)]


def test_detect_types_tests_distinct_texts(spark, monkeypatch):
    _, calls = counted_type(spark, monkeypatch)
    df = rows_of(spark, ["1", "2", "x"]).select("a", F.lit(None).cast("string").alias("b"), F.length("a").alias("n"))
    found = {tuple(r) for r in quality.detect_types(df.select("a", "b"), ["digits", "string"]).collect()}
    assert found == {("a", "digits", False), ("a", "string", True), ("b", "digits", True), ("b", "string", True)}
    assert calls.value == 3
    mixed = {tuple(r) for r in quality.detect_types(df, ["integer"]).collect()}
    assert mixed == {("a", "integer", False), ("b", "integer", True), ("n", "integer", True)}
    assert {r["fits"] for r in quality.detect_types(df.limit(0), ["integer"]).collect()} == {True}


def test_validation_judges_distinct_texts(spark, monkeypatch):
    schema, calls = counted_type(spark, monkeypatch)
    df = rows_of(spark, ["1", "2", "x", "y", None]).withColumn("free", F.lit(1))
    assert sorted(map(tuple, quality.distinct_rejects(df.select("a"), schema).collect())) == [("a", "digits", "x", 20), ("a", "digits", "y", 20)]
    assert calls.value == 4
    told = sorted(map(tuple, quality.validation_summary(df, schema).collect()))
    assert told == [("a", "digits", "invalid", 80, 40, 2), ("free", None, "unregistered", 100, 0, 0)]
    empty = sorted(map(tuple, quality.validation_summary(df.limit(0), schema).collect()))
    assert empty == [("a", "digits", "valid", 0, 0, 0), ("free", None, "unregistered", 0, 0, 0)]


def test_error_report_judges_distinct_texts_once(spark, monkeypatch, tmp_path):
    schema, calls = counted_type(spark, monkeypatch)
    write_report(quality.error_report(rows_of(spark, ["1", "x"]), schema, "r"), str(tmp_path / "report"))
    assert calls.value == 2
    assert spark.read.parquet(str(tmp_path / "report/rejects")).select("value", "n_rows").collect() == [("x", 20)]
    assert spark.read.parquet(str(tmp_path / "report/summary")).select("n_values", "n_invalid").collect() == [(40, 20)]


def test_text_profile_judges_distinct_values(spark, monkeypatch):
    schema, calls = counted_type(spark, monkeypatch)
    found = text_profile(rows_of(spark, ["1", "x", "y", None]), schema).collect()
    assert list(map(tuple, found)) == [("a", 60, 3, "1", 20, 40, 2)]
    assert calls.value == 3


def test_clean_derives_its_table_twice_at_most(spark):
    same, calls = counted(spark, lambda t: t)
    rows = spark.createDataFrame([(i, str(i % 30)) for i in range(40)] + [(7, "x"), (7, "x")], "row_id long, a string").repartition(1)
    found = clean(rows.select("row_id", same("a").alias("a")), SemanticSchema({"a": "string"}), "row_id")
    assert found.table.count() == 32 and found.duplicates.count() == 10
    assert calls.value <= 2 * 42


def test_suffixes_are_narrow_and_each_route_has_a_task(spark):
    df = spark.createDataFrame([("a b c. a b", "en")], "text string, lang string")
    counts = collocations.phrase_counts(df, least=1)
    assert "RepartitionByExpression [direct" in counts._jdf.queryExecution().toString()
    assert {(r["phrase"], r["n"]) for r in counts.where("len > 1").collect()} == {("a b", 2), ("b c", 1), ("a b c", 1)}
    ids = np.random.default_rng(1).choice([0, 1, 7, 60_000, 2_000_000], 3000).astype(np.int32)
    rows = collocations.suffixes(ids)
    assert rows.dtype == np.int32
    merged, n = collocations.merged(rows, np.ones(len(rows), np.int64), 2_000_000)
    assert dict(zip(map(tuple, merged.tolist()), n.tolist())) == Counter(map(tuple, rows.tolist()))


def test_texts_that_cannot_be_json_are_not_parsed_as_such(spark):
    texts = ["{'a': None}", "{'a': 'le'Set'}", "{'a': '\\x9a'}", "{'a': 'None'}", '{"a": "d\'or True"}', "{'a': '\\\\x'}", '{"a": NaN}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(nested._no_json(F.col("t"))).collect()] == [True, True, True, False, False, False, False]
    assert [r[0] for r in df.select(nested.extract_dict(F.col("t"))["a"]).collect()][:6] == [None, "le'Set", "\x9a", "None", "d'or True", "\\x"]
