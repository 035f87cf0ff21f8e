"""Profile states and running validation: merged parts against the whole."""

import pytest
from pyspark.sql import functions as F

from gritsieve.operators.quality import distinct_rejects, validation_summary
from gritsieve.operators.states import column_states, merge_states, profile_of
from gritsieve.schema import SemanticSchema
from gritsieve.streaming import validation

COLUMNS = ["x", "heavy", "none"]


def _numbers(spark):
    x = F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 77 == 0, float("nan")).otherwise(F.randn(5) * 3 + 1e3)
    made = spark.range(20_000).select("id", x.alias("x"), F.exp(3 * F.randn(6)).alias("heavy"), F.lit(None).cast("double").alias("none"))
    return spark.createDataFrame(made.collect(), made.schema)


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_merged_states_equal_the_state_of_all_rows(spark, parts):
    df = _numbers(spark).withColumn("part", F.when(F.col("id") < 3, -1).otherwise(F.pmod(F.hash("id"), F.lit(parts))))
    whole = {r["column"]: r for r in profile_of(column_states(df, COLUMNS)).collect()}
    merged = {r["column"]: r for r in profile_of(merge_states(column_states(df, COLUMNS, by=["part"]))).collect()}
    assert set(whole) == set(merged) == set(COLUMNS)
    for name in COLUMNS:
        for fact in ("count", "missing", "mean", "std", "variance", "skewness", "kurtosis", "min", "max", "range"):
            a, b = whole[name][fact], merged[name][fact]
            assert a == b or a == pytest.approx(b, rel=1e-8), (name, fact)
    for name in ("x", "heavy"):
        values = sorted(r[0] for r in df.where(F.col(name).isNotNull() & ~F.isnan(name)).select(name).collect())
        assert merged[name]["count"] == len(values)
        assert merged[name]["n_unique"] == pytest.approx(len(set(values)), rel=0.06)
        for q, fact in ((0.25, "q25"), (0.5, "median"), (0.75, "q75")):
            rank = sum(v <= merged[name][fact] for v in values) / len(values)
            assert abs(rank - q) < 0.015
    assert merged["none"]["count"] == 0 and merged["none"]["mean"] is None and merged["none"]["n_unique"] == 0 and merged["none"]["median"] is None


def test_states_of_nothing(spark):
    df = spark.createDataFrame([], "x double, heavy double, none double")
    rows = profile_of(merge_states(column_states(df, COLUMNS))).collect()
    assert len(rows) == 3 and all(r["count"] == 0 and r["missing"] == 0 for r in rows)


def test_running_validation_equals_the_whole_table(spark, tmp_path):
    schema = SemanticSchema({"id": "integer", "flag": "boolean"})
    text = F.when(F.col("n") % 5 == 0, "x").when(F.col("n") % 7 == 0, None).otherwise(F.col("n").cast("string"))
    df = spark.range(500).select(F.col("id").alias("n")).select("n", text.alias("id"), F.when(F.col("n") % 3 == 0, "maybe").otherwise("True").alias("flag"))
    df.repartition(5, "n").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    sums, log = str(tmp_path / "sums"), str(tmp_path / "log")

    def run():
        validation.validate_stream(stream, schema, sums, log, ["id"]).awaitTermination(90)

    def both():
        rejects = sorted(map(tuple, validation.running_rejects(spark, sums).collect()))
        return rejects, sorted(map(tuple, validation.running_summary(spark, sums).collect())), validation.running_states(spark, sums).select("n_rows", "n", "low", "high").collect()

    run()
    assert both()[0] == sorted(map(tuple, distinct_rejects(df, schema).collect()))
    assert both()[1] == sorted(map(tuple, validation_summary(df, schema).collect()))
    assert [tuple(r) for r in both()[2]] == [(500, 343, 1.0, 499.0)]
    assert len(list((tmp_path / "sums" / "rejects").iterdir())) > 1
    before = both()
    run()  # nothing new
    first = spark.read.parquet(*sorted(str(p) for p in (tmp_path / "in").glob("*.parquet"))[:1])
    validation.write_batch(first, 99, sums, schema, ["id"])
    validation.write_batch(first, 99, sums, schema, ["id"])  # a repeated batch counts once
    assert both()[2][0]["n_rows"] == before[2][0]["n_rows"] + first.count()
    df.limit(0).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert both()[2][0]["n_rows"] == before[2][0]["n_rows"] + first.count()
