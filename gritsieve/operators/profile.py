"""Column and table profiles as tidy tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gritsieve.operators import aggregates as agg
from gritsieve.operators.duplicates import find_duplicates, remove_duplicates
from gritsieve.operators.preview import grid
from gritsieve.operators.quality import droppable_columns
from gritsieve.schema import SemanticSchema, extract_columns, semantic_type


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All statistics of numeric columns, one row each."""
    counted = agg.distinct_and_mode(df, columns).select("column", "n_unique", "mode")
    return (
        agg.numeric_stats(df, columns)
        .join(counted, "column", "left")
        .withColumn("n_unique", F.coalesce("n_unique", F.lit(0)))
    )


def column_profile(df: DataFrame, col: str, schema: SemanticSchema, k: int = 10) -> dict[str, DataFrame]:
    """The k most frequent values and, for a numeric type, the statistics."""
    typed = extract_columns(df, schema, [col]) if dict(df.dtypes)[col] == "string" else df
    parts = {"top_values": agg.value_counts(df, col, k)}
    if schema.is_numeric(col):
        parts["stats"] = numeric_profile(typed, [col])
    return parts


def text_profile(df: DataFrame, schema: SemanticSchema) -> DataFrame:
    """Every text column's count, distinct count, top value and number of bad values."""
    bad = F.lit(False)
    for c in schema.known(df):
        bad = F.when(F.col("column") == c, ~semantic_type(schema.column_type(c)).is_valid(F.col("value"))).otherwise(bad)
    return agg.describe_text(df, df.columns, bad)


def all_columns_profile(df: DataFrame, schema: SemanticSchema) -> dict[str, DataFrame]:
    """All columns at once: text profile, and numeric profile of the numeric types."""
    numeric = [c for c in schema.known(df) if schema.is_numeric(c)]
    parts = {"text": text_profile(df, schema)}
    if numeric:
        parts["numeric"] = numeric_profile(extract_columns(df, schema, numeric), numeric)
    return parts


def columns_table(df: DataFrame, schema: SemanticSchema) -> DataFrame:
    """Column, declared dtype, semantic type, distinct values and percent missing."""
    facts = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column"),
            F.lit(schema.column_dtype(c)).alias("dtype"),
            F.lit(schema.column_type(c)).alias("semantic_type"),
            agg.null_percent(F.col(c)).alias("null_percent"),
        )
        for i, c in enumerate(df.columns)
    ]
    base = df.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))
    unique = agg.frequencies(df, df.columns).groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    return base.join(unique, "column", "left").select(
        "position", "column", "dtype", "semantic_type", F.coalesce("n_unique", F.lit(0)).alias("n_unique"), "null_percent"
    )


def table_profile(
    df: DataFrame,
    schema: SemanticSchema,
    order: str,
    keys: Sequence[str] = ("id", "title"),
    percent: int = 80,
    n: int = 3,
) -> dict[str, DataFrame]:
    """Shape, previews around duplicate removal and column tables around sparse-column removal."""
    unique = remove_duplicates(df, order, keys)
    data = unique.drop(order)
    return {
        "shape": agg.shape(df.drop(order)),
        "preview": grid(df, n, order, 8, 10),
        "duplicates": find_duplicates(df, order, keys),
        "preview_after": grid(unique, n, order, 8, 10),
        "columns_before": columns_table(data, schema),
        "columns_after": columns_table(data.drop(*droppable_columns(data, percent)), schema),
    }
