"""Running validation of a stream: distinct rejects, numbers of values and profile states, batch by batch.

Every micro-batch is summed up into a few small tables, each written to a folder of its own under
the batch's number. A batch that is repeated after a failure overwrites its own folders, so it
counts once. What has been seen so far is the merge of all folders; rows are never read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gritsieve.operators.quality import distinct_rejects
from gritsieve.operators.states import column_states, merge_states
from gritsieve.schema import SemanticSchema, extract_columns


def write_batch(batch: DataFrame, number: int, folder: str, schema: SemanticSchema, profiled: Sequence[str] = ()) -> None:
    """The tables of one batch; writing a batch again changes nothing.

    A batch comes in as many parts as it has file splits, often few; its rows are dealt to all tasks first.
    """
    kept = batch.repartition(int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions"))).persist()
    counts = [F.struct(F.lit(c).alias("column"), F.lit(schema.columns.get(c)).cast("string").alias("semantic_type"), F.count(c).alias("n_values")) for c in batch.columns]
    tables = {
        "rejects": distinct_rejects(kept, schema),
        "counts": kept.agg(F.array(*counts).alias("facts")).select(F.inline("facts")),
    }
    if profiled:
        tables["states"] = column_states(extract_columns(kept, schema, list(profiled)), profiled)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
    kept.unpersist()


def validate_stream(
    stream: DataFrame, schema: SemanticSchema, folder: str, checkpoint: str, profiled: Sequence[str] = (), available_now: bool = True
) -> StreamingQuery:
    """Start summing up a stream of text rows; by default stop when the present input is read."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, number: write_batch(batch, number, folder, schema, profiled)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def running_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct bad value of each column with its number of rows so far."""
    parts = spark.read.schema("column string, semantic_type string, value string, n_rows long").parquet(f"{folder}/rejects")
    return parts.groupBy("column", "semantic_type", "value").agg(F.sum("n_rows").alias("n_rows"))


def running_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Per column: status and numbers of values, invalid cells and distinct bad values so far."""
    counts = spark.read.schema("column string, semantic_type string, n_values long").parquet(f"{folder}/counts")
    counts = counts.groupBy("column", "semantic_type").agg(F.sum("n_values").alias("n_values"))
    bad = running_rejects(spark, folder).groupBy("column").agg(F.sum("n_rows").alias("n_invalid"), F.count(F.lit(1)).alias("n_distinct_bad"))
    status = F.when(F.col("semantic_type").isNull(), "unregistered").when(F.col("n_invalid") > 0, "invalid").otherwise("valid")
    return counts.join(bad, "column", "left").select(
        "column", "semantic_type", status.alias("status"), "n_values",
        F.coalesce("n_invalid", F.lit(0)).alias("n_invalid"), F.coalesce("n_distinct_bad", F.lit(0)).alias("n_distinct_bad"),
    )


def running_states(spark: SparkSession, folder: str) -> DataFrame:
    """The profile states of the columns so far."""
    return merge_states(spark.read.parquet(f"{folder}/states").drop("batch"))
