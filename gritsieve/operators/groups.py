"""Group facts put back on rows, positions inside groups and running totals.

A plain window over a key sends all rows of that key to one task. Here group facts come from
an aggregate with map-side combine and return to the rows by a join that spreads heavy keys;
positions and running totals work on blocks whose totals are small.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from gritsieve.session import ensure_checkpoint_dir

SALTS = 1024


def _same_key(left: DataFrame, right: DataFrame, keys: Sequence[str], nulls_equal: bool) -> Column:
    pairs = [
        left[k].eqNullSafe(right[f"__{k}"]) if nulls_equal else left[k] == right[f"__{k}"] for k in keys
    ]
    return reduce(and_, pairs)


def lookup(
    df: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    size: str,
    nulls_equal: bool = True,
    heavy_share: float = 0.001,
) -> DataFrame:
    """Left join of facts (one row per key, ``size`` = rows of that key) that no key can skew.

    Keys above ``heavy_share`` of all rows number at most ``1 / heavy_share``, so their facts
    are broadcast. The rows they match, and rows without a key where nulls match nothing, carry
    a salt into the second join, which meets no partner there and spreads them over all tasks;
    the other keys join by shuffle. The other side's salt is computed from its rows: the
    optimizer would turn a constant into a filter and shuffle by the key alone.
    """
    facts = facts.select(*[F.col(k).alias(f"__{k}") for k in keys], *values, F.col(size).alias("__size"))
    limit = F.lit(heavy_share) * facts.agg(F.sum("__size")).scalar()
    heavy = facts.where(F.col("__size") > limit)
    light = facts.where(F.col("__size") <= limit)
    named = lambda prefix: [F.col(v).alias(f"{prefix}{v}") for v in values]
    renamed = [f"__{k}" for k in keys]

    heavy = heavy.select(*renamed, *named("__heavy_"), F.lit(True).alias("__is_heavy"))
    tagged = df.join(F.broadcast(heavy), _same_key(df, heavy, keys, nulls_equal), "left").drop(*renamed)
    spread = F.col("__is_heavy")
    if not nulls_equal:
        spread = reduce(or_, [tagged[k].isNull() for k in keys], F.coalesce(spread, F.lit(False)))
    tagged = tagged.withColumn(
        "__salt", F.when(spread, F.monotonically_increasing_id() % SALTS + 1).otherwise(F.lit(0)).cast("int")
    )
    light = light.select(*renamed, *named("__light_"), F.when(F.col("__size") >= 0, F.lit(0)).alias("__zero"))
    joined = tagged.join(
        light, _same_key(tagged, light, keys, nulls_equal) & (tagged["__salt"] == light["__zero"]), "left"
    )
    return joined.select(
        *[df[c] for c in df.columns],
        *[F.coalesce(F.col(f"__heavy_{v}"), F.col(f"__light_{v}")).alias(v) for v in values],
    )


def with_group_facts(
    df: DataFrame, keys: Sequence[str], facts: dict[str, Column], nulls_equal: bool = True
) -> DataFrame:
    """Add aggregates over each row's key group to the row."""
    grouped = df if nulls_equal else df.where(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    summary = grouped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__rows"), *[c.alias(name) for name, c in facts.items()]
    )
    return lookup(df, summary, keys, list(facts), "__rows", nulls_equal)


def group_size(df: DataFrame, key: str, out: str = "group_size") -> DataFrame:
    """Rows in the key's group; null for the null key."""
    return with_group_facts(df, [key], {out: F.count(F.lit(1))}, nulls_equal=False)


def flag_duplicates(df: DataFrame, keys: Sequence[str], out: str = "is_duplicate") -> DataFrame:
    """True on every member of a group of two or more; nulls are equal."""
    sized = with_group_facts(df, keys, {"__n": F.count(F.lit(1))})
    return sized.withColumn(out, F.col("__n") > 1).drop("__n")


def flag_repeats(
    df: DataFrame, keys: Sequence[str], order: str, out: str = "is_repeat"
) -> DataFrame:
    """True on all members of a group but the first by ``order`` (unique values)."""
    firsts = with_group_facts(df, keys, {"__first": F.min(order)})
    return firsts.withColumn(out, F.col(order) > F.col("__first")).drop("__first")


def blocks_of(df: DataFrame, order: str, blocks: int | None = None) -> DataFrame:
    """Add ``__block``: consecutive blocks of like numbers of rows along a numeric order."""
    blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("__order", F.col(order).cast("double"))
    shares = [i / blocks for i in range(1, blocks)]
    marks = rows.stat.approxQuantile("__order", shares, 0.1 / blocks) if shares else []
    splits = [float("-inf"), *sorted(set(marks)), float("inf")]
    if len(splits) == 2:
        return rows.withColumn("__block", F.lit(0.0))
    return Bucketizer(splits=splits, inputCol="__order", outputCol="__block").transform(rows)


def position_in_group(
    df: DataFrame, keys: Sequence[str], order: str, out: str = "position", blocks: int | None = None
) -> DataFrame:
    """1-based position inside the group by ``order`` (numeric, unique); null keys drop out.

    The order axis is cut at approximate quantiles into blocks, so a heavy key spreads over
    as many tasks. Positions inside (key, block) are shifted by the sizes of earlier blocks.
    """
    rows = blocks_of(df.dropna(subset=list(keys)), order, blocks)
    inside = Window.partitionBy(*keys, "__block").orderBy(order)
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "__block")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        .drop("__n")
    )
    numbered = rows.withColumn("__inside", F.row_number().over(inside))
    return numbered.join(offsets, [*keys, "__block"]).select(
        *df.columns, (F.col("__inside") + F.col("__before")).alias(out)
    )


def running_total(
    df: DataFrame, order: str, value: str, out: str = "running_total", unique: bool = False
) -> DataFrame:
    """Sum of ``value`` over all rows up to the row's numeric ``order``, ties included.

    With ``unique`` no order comes twice, as after an aggregate by it: one exchange by ranges
    of the order cuts the rows into blocks and nothing has to be put back.

    Values are summed by order first, so ties are one entry; entries are cut at approximate
    quantiles into blocks, whose sums alone are accumulated in one task; rows get their total
    by a lookup that no order can skew. Rows without an order have no total. The input is read
    more than once, so it is checkpointed first.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if unique:
        return _running_total_of_entries(df, order, value, out)
    rows = df.checkpoint()
    entries = rows.where(F.col(order).isNotNull()).groupBy(order).agg(F.sum(value).alias("__sum"), F.count(F.lit(1)).alias("__rows"))
    entries = blocks_of(entries.checkpoint(), order)
    inside = Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        entries.groupBy("__block")
        .agg(F.sum("__sum").alias("__total"))
        .select("__block", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before"))
    )
    totals = entries.withColumn("__inside", F.sum("__sum").over(inside)).join(before, "__block")
    totals = totals.select(order, "__rows", (F.col("__inside") + F.col("__before")).alias(out))
    return lookup(rows, totals, [order], [out], "__rows", nulls_equal=False)


def _running_total_of_entries(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Blocks are the partitions of a range exchange, kept in a checkpoint so that both readers see the same."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, order).withColumn("__block", F.spark_partition_id()).checkpoint()
    counted = F.when(F.col(order).isNotNull(), F.col(value))
    inside = Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("__block").agg(F.sum(counted).alias("__total"))
    before = before.select("__block", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before"))
    totals = rows.withColumn("__inside", F.sum(counted).over(inside)).join(before, "__block")
    total = F.when(F.col(order).isNotNull(), F.coalesce(F.col("__inside"), F.lit(0)) + F.col("__before"))
    return totals.select(*df.columns, total.alias(out))


def top_per_group(df: DataFrame, keys: Sequence[str], best: Sequence[Column]) -> DataFrame:
    """The first row of each group by ``best``; with rank 1 only, Spark prunes before the shuffle."""
    rank = Window.partitionBy(*keys).orderBy(*best)
    return df.withColumn("__rank", F.row_number().over(rank)).where("__rank = 1").drop("__rank")
