"""Standard and min-max scaling, clamping and outlier removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F

from gritsieve.operators.aggregates import numeric_stats
from gritsieve.operators.relational import within_threshold
from gritsieve.schema import SemanticSchema, physical_numeric_columns

VARIANTS = ("original", "clamped", "clamped_minmax", "dropped", "dropped_minmax")


def _fit(df: DataFrame, columns: Sequence[str]) -> Row:
    """All columns' means, deviations and ranges: one row, from one pass."""
    facts = []
    for i, c in enumerate(columns):
        facts += [
            F.avg(c).alias(f"mean{i}"),
            F.stddev_pop(c).alias(f"sd{i}"),
            F.min(c).alias(f"min{i}"),
            F.max(c).alias(f"max{i}"),
        ]
    return df.agg(*facts).first()


def _as_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def standard_scale(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """z-scores by the population deviation; constants give zero, nulls stay null."""
    columns = list(columns or physical_numeric_columns(df))
    numbers = _as_numbers(df, columns)
    fit = _fit(numbers, columns)
    scaled = {c: (F.col(c) - fit[f"mean{i}"]) / (fit[f"sd{i}"] or 1.0) for i, c in enumerate(columns) if fit[f"sd{i}"] is not None}
    return numbers.withColumns(scaled)


def minmax_scale(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """To [0, 1]; constants give zero."""
    columns = list(columns or physical_numeric_columns(df))
    numbers = _as_numbers(df, columns)
    fit = _fit(numbers, columns)
    scaled = {
        c: (F.col(c) - fit[f"min{i}"]) / ((fit[f"max{i}"] - fit[f"min{i}"]) or 1.0)
        for i, c in enumerate(columns)
        if fit[f"min{i}"] is not None
    }
    return numbers.withColumns(scaled)


def clamp(c: Column, threshold: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(-threshold)), F.lit(threshold)))


def clamp_columns(df: DataFrame, columns: Sequence[str], threshold: float = 3.0) -> DataFrame:
    return df.withColumns({c: clamp(F.col(c), threshold) for c in columns})


def drop_outliers(df: DataFrame, columns: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """Rows of a scaled frame with every score inside ±threshold."""
    return within_threshold(df, columns, threshold)


def autoscale(df: DataFrame, schema: SemanticSchema, columns: Sequence[str] | None = None) -> DataFrame:
    """Scale the columns of numeric type; invalid text becomes null."""
    columns = list(columns or [c for c in schema.known(df) if schema.is_numeric(c)])
    kinds = dict(df.dtypes)
    typed = df.withColumns(
        {c: schema.extractor(c)(F.col(c)) if kinds[c] == "string" else F.col(c) for c in columns}
    )
    return standard_scale(typed, columns) if columns else typed


def scaler_variants(
    df: DataFrame, col: str, columns: Sequence[str] | None = None, threshold: float = 3.0
) -> DataFrame:
    """One column per variant of ``col``; dropped rows are null in the dropped variants.

    A row is dropped if any of ``columns`` (default: all numeric ones) is an outlier.
    """
    columns = list(columns or physical_numeric_columns(df))
    scaled = standard_scale(df.select(*columns, F.col(col).cast("double").alias("original")), columns)
    inside = F.lit(True)
    for c in columns:
        inside = inside & F.coalesce(F.abs(c) <= threshold, F.lit(False))
    parts = scaled.select(
        "original",
        clamp(F.col(col), threshold).alias("clamped"),
        F.when(inside, F.col(col)).alias("dropped"),
    )
    again = parts.withColumns({"clamped_minmax": F.col("clamped"), "dropped_minmax": F.col("dropped")})
    return minmax_scale(again, ["clamped_minmax", "dropped_minmax"]).select(*VARIANTS)


def compare_scalers(
    df: DataFrame, col: str, columns: Sequence[str] | None = None, threshold: float = 3.0
) -> DataFrame:
    """Statistics of the five variants of a column, one row each."""
    stats = numeric_stats(scaler_variants(df, col, columns, threshold), VARIANTS)
    return stats.withColumnRenamed("column", "variant")
