"""Typing and validation of a stream: the extractors are stateless, so they apply unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gritsieve.operators.quality import cell_rejects
from gritsieve.schema import SemanticSchema, extract_columns


def typed_stream(stream: DataFrame, schema: SemanticSchema) -> DataFrame:
    return extract_columns(stream, schema)


def rejects_stream(stream: DataFrame, schema: SemanticSchema, row_id: str) -> DataFrame:
    return cell_rejects(stream, schema, row_id)


def write_stream(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to parquet exactly once; by default stop when the present input is read."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
