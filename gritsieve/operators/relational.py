"""Projections, filters, joins, sorts, limits and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from gritsieve.functions import nested, scalars
from gritsieve.operators.groups import lookup


# -- projections -------------------------------------------------------------------------

def edge_columns(df: DataFrame, n: int, filler: str = "...") -> DataFrame:
    """First n and last n columns with a filler between; all columns if there are at most 2n."""
    if len(df.columns) <= 2 * n:
        return df
    return df.select(*df.columns[:n], F.lit("...").alias(filler), *df.columns[-n:])


def short_names(df: DataFrame, size: int) -> DataFrame:
    """Column names cut to ``size`` characters; colliding ones get a number."""
    names: list[str] = []
    for name in df.columns:
        short = name if len(name) <= size else name[: size - 1] + "…"
        names.append(short if short not in names else f"{short}{sum(n.startswith(short) for n in names) + 1}")
    return df.toDF(*names)


def difference(df: DataFrame, left: str, right: str, out: str) -> DataFrame:
    return df.withColumn(out, scalars.to_numeric(F.col(left)) - scalars.to_numeric(F.col(right)))


def overwrite_where(df: DataFrame, col: str, value: Column, condition: Column) -> DataFrame:
    """Replace a cell where the condition is true, keep it otherwise."""
    return df.withColumn(col, F.when(condition, value).otherwise(F.col(col)))


def beside(df: DataFrame, **constants) -> DataFrame:
    """Constant columns appended on the right."""
    return df.select("*", *[F.lit(v).alias(k) for k, v in constants.items()])


# -- filters -----------------------------------------------------------------------------

def not_null(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(subset=list(cols))


def numeric_where(df: DataFrame, col: str, low: float) -> DataFrame:
    """Rows whose text reads as a number above ``low``."""
    return df.where(scalars.to_numeric(F.col(col)) > low)


def matching(df: DataFrame, col: str, pattern: str) -> DataFrame:
    return df.where(F.col(col).rlike(pattern))


def not_matching(df: DataFrame, col: str, pattern: str) -> DataFrame:
    return df.where(~F.col(col).rlike(pattern))


def not_empty(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col) != "")


def pattern_conformity(df: DataFrame, col: str, pattern: str = scalars.YMD_TEXT) -> DataFrame:
    """How many texts match a pattern, do not, or are null."""
    c = F.col(col)
    return df.agg(
        F.count_if(c.rlike(pattern)).alias("matching"),
        F.count_if(~c.rlike(pattern)).alias("not_matching"),
        F.count_if(c.isNull()).alias("nulls"),
    )


def of_json_kind(df: DataFrame, col: str, kind: str) -> DataFrame:
    return df.where(nested.object_kind(F.col(col)) == kind)


def within_threshold(df: DataFrame, cols: Sequence[str], threshold: float) -> DataFrame:
    """Rows whose scores are all inside ±threshold; rows with a missing score drop out."""
    return df.where(reduce(and_, [F.abs(c) <= threshold for c in map(F.col, cols)]))


# -- joins -------------------------------------------------------------------------------

def without_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is not among the keys, which may repeat."""
    return df.join(keys.distinct(), on, "left_anti")


def with_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is among the keys, which may repeat."""
    return df.join(keys.distinct(), on, "left_semi")


def explode_list(df: DataFrame, col: str, out: str) -> DataFrame:
    """One row per list element, as canonical JSON text; empty and unreadable lists give none."""
    return df.withColumn(out, F.explode(nested.list_elements(F.col(col))))


def normalise(
    df: DataFrame, key: str, col: str, fields: dict[str, str], item_key: str
) -> tuple[DataFrame, DataFrame]:
    """Split a record-list column into a dimension and a (key, item key) bridge table.

    The dimension has one row per item key and the number of records that name it.
    """
    items = df.select(key, F.explode(nested.typed_records(F.col(col), fields)).alias("item"))
    dimension = items.groupBy(F.col(f"item.{item_key}").alias(item_key)).agg(
        *[F.min(f"item.{f}").alias(f) for f in fields if f != item_key], F.count(F.lit(1)).alias("n_records")
    )
    bridge = items.select(key, F.col(f"item.{item_key}").alias(item_key)).distinct()
    return dimension, bridge


def denormalise(df: DataFrame, bridge: DataFrame, dimension: DataFrame, key: str, item_key: str) -> DataFrame:
    """One row per row and item, with the item's fields; an item in very many rows cannot skew it."""
    fields = [c for c in dimension.columns if c not in (item_key, "n_records")]
    named = lookup(bridge.where(F.col(item_key).isNotNull()), dimension, [item_key], fields, "n_records", nulls_equal=False)
    return df.join(named, key)


# -- sorts, limits, sets -----------------------------------------------------------------

def sorted_by(df: DataFrame, key: Column, descending: bool = False) -> DataFrame:
    """Nulls last when ascending, first when descending."""
    return df.orderBy(key.desc_nulls_first() if descending else key.asc_nulls_last())


def nth_row(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The n-th row of an ordering."""
    return df.orderBy(*order).offset(n - 1).limit(1)


def nth_value_rows(df: DataFrame, n: int, col: str) -> DataFrame:
    """All rows that hold the n-th highest distinct value."""
    nth = df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(F.desc(col)).offset(n - 1).limit(1)
    return df.where(F.col(col) == nth.scalar())


def head_and_tail(df: DataFrame, n: int, order: str) -> DataFrame:
    """First n and last n rows by ``order`` (unique), none twice."""
    head = df.orderBy(F.asc(order)).limit(n)
    last_of_head = head.agg(F.max(order)).scalar()
    tail = df.where(F.col(order) > last_of_head).orderBy(F.desc(order)).limit(n)
    return head.unionAll(tail)


def concatenate(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()
