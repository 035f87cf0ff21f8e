"""The five business questions over an all-text table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gritsieve.functions import nested, scalars
from gritsieve.operators.groups import running_total, top_per_group
from gritsieve.operators.relational import explode_list

# Fixed value: what counts as a plain amount.
AMOUNT_TEXT = r"^[0-9]+(\.[0-9]+)?\z"


def nth_highest(
    df: DataFrame, key: str, value: str, n: int = 3, ties: bool = True, as_text: bool = False
) -> DataFrame:
    """Rows with the n-th highest positive value.

    ``ties`` returns every row that holds the n-th distinct value, otherwise one row is
    taken (ties by key). ``as_text`` ranks the texts instead of the numbers.
    """
    rows = df.withColumn("__number", scalars.to_numeric(F.col(value))).where("__number > 0")
    rank = F.col(value) if as_text else F.col("__number")
    rows = rows.withColumn("__rank", rank)
    if not ties:
        return rows.orderBy(F.desc("__rank"), F.asc(key)).offset(n - 1).limit(1).select(*df.columns)
    nth = rows.select("__rank").distinct().orderBy(F.desc("__rank")).offset(n - 1).limit(1)
    return rows.where(F.col("__rank") == nth.scalar()).select(*df.columns)


def losses(df: DataFrame, key: str, revenue: str, budget: str, out: str = "profit") -> DataFrame:
    """Rows with a key whose plain revenue is below their plain budget, with the difference."""
    gained, spent = scalars.to_numeric(F.col(revenue)), scalars.to_numeric(F.col(budget))
    plain = F.col(revenue).rlike(AMOUNT_TEXT) & F.col(budget).rlike(AMOUNT_TEXT)
    return df.where(plain & (gained < spent) & (F.col(key) != "")).withColumn(out, gained - spent)


def worst_losses(df: DataFrame, key: str, revenue: str, budget: str, n: int = 10) -> DataFrame:
    return losses(df, key, revenue, budget).orderBy(F.asc("profit"), F.asc(key)).limit(n)


def first_losses(df: DataFrame, key: str, revenue: str, budget: str, n: int = 3) -> DataFrame:
    return losses(df, key, revenue, budget).orderBy(F.asc(key)).limit(n)


def average_by_item(df: DataFrame, items: str, value: str, n: int | None = None) -> DataFrame:
    """Rounded average of the plain values per list element, highest first."""
    rows = df.where(F.col(value).rlike(AMOUNT_TEXT)).select(items, scalars.to_numeric(F.col(value)).alias("value"))
    averages = (
        explode_list(rows, items, "item").groupBy("item").agg(F.round(F.avg("value")).cast("bigint").alias("average"))
    )
    ordered = averages.orderBy(F.desc("average"), F.asc("item"))
    return ordered if n is None else ordered.limit(n)


def with_list_length(df: DataFrame, items: str, out: str = "n_items") -> DataFrame:
    """Number of list elements; null where the text is no list."""
    return df.withColumn(out, nested.list_length(F.col(items)))


def list_length_distribution(df: DataFrame, items: str, above: int = 1) -> DataFrame:
    """(n_items, count, running): how many rows have each length above a bound, and up to it."""
    # lengths are filtered when counted: a filter below the aggregate would parse every list twice
    counts = with_list_length(df.select(items), items).groupBy("n_items").agg(F.count(F.lit(1)).alias("count")).where(F.col("n_items") > above)
    return running_total(counts, "n_items", "count", "running", unique=True)


def list_length_range(df: DataFrame, items: str) -> DataFrame:
    lengths = with_list_length(df.select(items), items)
    return lengths.agg(F.min("n_items").alias("shortest"), F.max("n_items").alias("longest"))


def top_item_per_month(df: DataFrame, items: str, month: Column) -> DataFrame:
    """The most frequent list element of every month; equal counts by element."""
    rows = df.select(items, month.alias("month")).where("month is not null")
    counts = explode_list(rows, items, "item").groupBy("month", "item").agg(F.count(F.lit(1)).alias("item_count"))
    return top_per_group(counts, ["month"], [F.desc("item_count"), F.asc("item")])
