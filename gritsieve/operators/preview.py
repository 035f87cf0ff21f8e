"""Bounded previews of wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gritsieve.functions.text import format_value
from gritsieve.operators.relational import edge_columns, head_and_tail


def formatted(df: DataFrame, size: int, width: int, justify: str | None = None) -> DataFrame:
    """Every cell as display text."""
    return df.select(
        *[format_value(F.col(f.name), f.dataType, size, width, justify).alias(f.name) for f in df.schema]
    )


def grid(df: DataFrame, n: int, order: str, size: int = 8, width: int = 10) -> DataFrame:
    """First and last n rows by ``order`` and first and last n columns, formatted.

    Only the shown columns are read.
    """
    shown = edge_columns(df.drop(order), n)
    kept = [c for c in shown.columns if c in df.columns]
    cells = head_and_tail(df.select(order, *kept), n, order)
    picks = []
    for c in shown.columns:
        if c in kept:
            picks.append(format_value(F.col(c), cells.schema[c].dataType, size, width).alias(c))
        else:
            picks.append(F.lit(c).alias(c))
    return cells.select(F.col(order), *picks).orderBy(order)
