"""Duplicate rows, found by aggregates so that no copy group meets in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType


def row_digest(*columns: Column) -> Column:
    """256-bit digest of the columns, for grouping long texts by a short key."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def _group_keys(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """What to group equal rows by: of text columns a digest, so that whole texts are not shuffled."""
    if all(isinstance(df.schema[c].dataType, StringType) for c in columns):
        return [row_digest(*map(F.col, columns)).alias("__digest")]
    return [F.col(c) for c in columns]


def duplicate_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """How many rows repeat an earlier one; nulls are equal."""
    groups = df.groupBy(*_group_keys(df, columns or df.columns)).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def first_rows(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """The order values of each group's first row."""
    return df.groupBy(*_group_keys(df, columns)).agg(F.min(order).alias(order)).select(order)


def drop_exact_duplicates(
    df: DataFrame, order: str | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """One row per group of equal rows.

    Without ``order`` the rows are equal in every column and any copy will do; with it
    (unique values) the first copy by order is kept.
    """
    if order is None:
        return df.dropDuplicates(list(columns) if columns else None)
    columns = columns or [c for c in df.columns if c != order]
    return df.join(first_rows(df, columns, order), order, "left_semi")


def repeated_rows(df: DataFrame, order: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows ``drop_exact_duplicates`` removes."""
    columns = columns or [c for c in df.columns if c != order]
    return df.join(first_rows(df, columns, order), order, "left_anti")


def find_duplicates(df: DataFrame, order: str, keys: Sequence[str] = ("id", "title")) -> DataFrame:
    """The first row of every id that has rows equal in all keys, with the id's duplicate count.

    ``keys[0]`` is the id. Rows are flagged by all keys but counted by id, and a null id
    drops out.
    """
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"missing key columns: {missing}")
    key, rest = keys[0], list(keys[1:])
    pairs = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.min(order).alias(order))
        .where((F.col("n") > 1) & F.col(key).isNotNull())
    )
    first = F.min(F.struct(order, *rest))
    return pairs.groupBy(key).agg(
        *[first[c].alias(c) for c in [*rest, order]], F.sum("n").alias("count")
    )


def remove_duplicates(
    df: DataFrame, order: str, keys: Sequence[str] = ("id", "title"), mode: str = "keep_first"
) -> DataFrame:
    """Remove flagged duplicates.

    'keep_first' leaves the first row of each equal group; 'drop_first' removes only the
    first row of each flagged id.
    """
    if mode == "keep_first":
        return drop_exact_duplicates(df, order, keys)
    if mode == "drop_first":
        return df.join(find_duplicates(df, order, keys).select(order), order, "left_anti")
    raise ValueError(f"unknown mode: {mode}")
