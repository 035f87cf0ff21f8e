"""Clusterings of one column: mean shift, Ward, self-organising map."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from heapq import heapify, heappop, heappush, heappushpop
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from gritsieve.functions.scalars import drop_nan
from gritsieve.operators.groups import blocks_of, running_total
from gritsieve.operators.histogram import column_values, summarise
from gritsieve.operators.points import distinct_points
from gritsieve.session import ensure_checkpoint_dir



def _running_extremes(df: DataFrame, order: list[str], up: list[str], down: list[str]) -> DataFrame:
    """Replace columns by their running maxima in order (``up``) or in reverse their running minima (``down``).

    Only the extremes of blocks of the first order column are taken in one task.
    """
    rows = blocks_of(df, order[0]).checkpoint()
    block = rows.groupBy("__block").agg(*[F.max(c).alias(f"__{c}") for c in up], *[F.min(c).alias(f"__{c}") for c in down])
    earlier = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy("__block").rowsBetween(1, Window.unboundedFollowing)
    beyond = block.select("__block", *[F.max(f"__{c}").over(earlier).alias(f"__{c}") for c in up], *[F.min(f"__{c}").over(later).alias(f"__{c}") for c in down])
    # both frames grow row by row: one that shrinks to the end of its block is computed anew for every row
    growing = lambda by: Window.partitionBy("__block").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    before, after = growing(order), growing([F.desc(c) for c in order])
    rows = rows.withColumns({c: F.max(c).over(before) for c in up} | {c: F.min(c).over(after) for c in down}).join(beyond, "__block")
    merged = {c: F.greatest(c, f"__{c}") for c in up} | {c: F.least(c, f"__{c}") for c in down}
    return rows.withColumns(merged).select(*df.columns)


def _neighbour_bandwidth(cumulative: DataFrame, n: int, quantile: float) -> float:
    """Mean distance of a value to its (quantile * n)-th neighbour, from (x, w, upto) rows.

    The nearest k rows of x are k consecutive ranks L .. L+k-1. The best L is where the sum of
    the two outer values passes 2x; that sum changes only at ranks where a value begins on one
    side, so sorting these ranks among the doubled values finds it for all values at once.
    """
    k = max(int(n * quantile), 1)
    none = F.lit(None).cast("double")
    first = (F.col("upto") - F.col("w")).cast("double")
    sides = cumulative.select(first.alias("at"), F.col("x").alias("low"), none.alias("high"))
    sides = sides.unionByName(cumulative.select((first - (k - 1)).alias("at"), none.alias("low"), F.col("x").alias("high")))
    steps = sides.groupBy("at").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    steps = _running_extremes(steps, ["at"], ["low", "high"], []).where(F.col("at").between(0, n - k))
    marks = steps.select((F.col("low") + F.col("high")).alias("place"), F.lit(1).alias("kind"), "low", "high", none.alias("x"), none.alias("w"))
    wanted = cumulative.select((2 * F.col("x")).alias("place"), F.lit(0).alias("kind"), none.alias("low"), none.alias("high"), "x", "w")
    met = _running_extremes(marks.unionByName(wanted), ["place", "kind"], ["low"], ["high"]).where("kind = 0")
    reach = F.least(F.col("high") - F.col("x"), F.col("x") - F.col("low"))
    return met.agg(F.sum(reach * F.col("w")) / n).first()[0]


BLOCK = 4096  # values of a packed block
CACHED = 1024  # blocks the driver holds at most, 24 bytes a value
GROUP = 256  # seeds that move together


class _Prefixes:
    """Numbers and sums of all values up to any position, from packed blocks of a sorted table.

    The driver knows where each block begins and fetches those that a lookup falls into; seeds
    that hardly move find theirs at hand, so jobs follow the blocks that are new, not the lookups.
    """

    def __init__(self, cumulative: DataFrame, values_lo: float):
        parts = int(cumulative.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.lo = values_lo
        rows = cumulative.select("x", "upto", "sum_upto").repartitionByRange(parts, "x").sortWithinPartitions("x")

        def pack(batches):
            for batch in batches:
                for at in range(0, len(batch), BLOCK):
                    columns = [batch.column(i).slice(at, BLOCK).to_numpy() for i in range(3)]
                    yield pa.RecordBatch.from_arrays([pa.array([float(columns[0][0])]), *(pa.array([c.astype("<f8").tobytes()], pa.binary()) for c in columns)], ["first", "x", "n", "s"])

        self.blocks = rows.mapInArrow(pack, "first double, x binary, n binary, s binary").checkpoint()
        self.firsts = np.sort(self.blocks.select("first").toArrow()["first"].to_numpy())
        self.held: dict[int, tuple[np.ndarray, ...]] = {}

    def _fetch(self, wanted: np.ndarray) -> None:
        new = [b for b in wanted.tolist() if b not in self.held]
        if new:
            if len(self.held) + len(new) > CACHED:
                self.held = {b: self.held[b] for b in wanted.tolist() if b in self.held}
            found = self.blocks.where(F.col("first").isin(self.firsts[new].tolist())).collect()
            for r in found:
                at = int(np.searchsorted(self.firsts, r["first"]))
                self.held[at] = tuple(np.frombuffer(r[c], "<f8") for c in ("x", "n", "s"))

    def __call__(self, below: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and sum of the values in each closed range [below, upto]."""
        bounds = np.concatenate([np.nextafter(below, -np.inf), upto])
        owner = np.searchsorted(self.firsts, bounds, "right") - 1
        n, s = np.zeros(len(bounds)), np.zeros(len(bounds))
        wanted = np.unique(owner[owner >= 0])
        self._fetch(wanted)
        for b in wanted.tolist():
            x, upto_n, upto_s = self.held[b]
            own = np.flatnonzero(owner == b)
            at = np.searchsorted(x, bounds[own], "right") - 1
            n[own], s[own] = upto_n[at], upto_s[at]
        half = len(below)
        held = n[half:] - n[:half]
        return held, s[half:] - s[:half] + held * self.lo


def _path(within: Callable, seeds: np.ndarray, bandwidth: float, most: int = 300) -> list[np.ndarray]:
    """Positions of the seeds shift by shift, until none moves at all."""
    path = [seeds]
    for _ in range(most):
        held, sums = within(path[-1] - bandwidth, path[-1] + bandwidth)
        moved = np.where(held > 0, sums / np.maximum(held, 1e-300), path[-1])
        path.append(moved)
        if (moved == path[-2]).all():
            break
    return path


def _shift_to_means(within: Callable, seeds: np.ndarray, bandwidth: float) -> list[tuple[float, float]]:
    """(center, values within reach) of a flat-kernel mean shift, strongest first.

    Seeds do not meet, so neighbours move in groups; all stop at the first shift in which none
    of them moved by a thousandth of the bandwidth.
    """
    paths = [_path(within, seeds[at : at + GROUP], bandwidth) for at in range(0, len(seeds), GROUP)]
    longest = max(map(len, paths))
    at = lambda p, t: p[min(t, len(p) - 1)]
    stop = next((t for t in range(1, longest) if all(np.abs(at(p, t) - at(p, t - 1)).max() < 1e-3 * bandwidth for p in paths)), longest - 1)
    seeds = np.unique(np.concatenate([at(p, stop) for p in paths]))
    held = np.concatenate([within(s - bandwidth, s + bandwidth)[0] for s in np.split(seeds, range(GROUP, len(seeds), GROUP))])
    kept: list[tuple[float, float]] = []
    centers = np.zeros(0)
    for strength, center in sorted(zip(held.tolist(), seeds.tolist()), reverse=True):
        if strength > 0 and (np.abs(centers - center) > bandwidth).all():
            kept.append((center, strength))
            centers = np.append(centers, center)
    return kept


def mean_shift_centers(df: DataFrame, col: str, quantile: float = 0.2) -> DataFrame:
    """(center, n_within, bandwidth): strongest centers first removed of weaker ones.

    Bandwidth, means and counts are those of all rows, looked up in the distinct values'
    running counts and sums. Seeds are the occupied
    cells of one bandwidth; as the bandwidth is the mean reach to a fifth of all rows, there are
    fewer than 3 times the square root of the rows.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    values = column_values(df, col)
    facts = summarise(values)
    counts = values.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("w")).checkpoint()
    upto = running_total(counts, "x", "w", "upto", unique=True).withColumn("gap", (F.col("x") - facts.lo) * F.col("w"))
    cumulative = running_total(upto, "x", "gap", "sum_upto", unique=True).drop("gap").checkpoint()
    bandwidth = _neighbour_bandwidth(cumulative, facts.n, quantile)
    if bandwidth <= 0:
        found = [(facts.lo, float(facts.n))]
    else:
        cells = counts.groupBy(F.round(F.col("x") / bandwidth).alias("cell")).count().orderBy("cell").collect()
        seeds = np.array([r["cell"] for r in cells]) * bandwidth
        found = _shift_to_means(_Prefixes(cumulative, facts.lo), seeds, bandwidth)
    rows = [(c, int(n), bandwidth) for c, n in sorted(found)]
    return spark.createDataFrame(rows, "center double, n_within bigint, bandwidth double")


_PIECE = "lo double, hi double, n double, mean double, border double, cost double"


class _Chain:
    """Neighbouring clusters of one stretch of the value axis, merged as far as the stretch decides.

    A pair is merged if no neighbour of either is nearer, which Ward's method allows in any
    order. What lies beyond an open end is unknown, so the outermost cluster there stays.
    """

    def __init__(self, pieces: np.ndarray, first: bool, last: bool):
        self.lo, self.hi, self.n, self.mean = (pieces[:, i].tolist() for i in range(4))
        size = len(self.n)
        self.left, self.right = list(range(-1, size - 1)), [*range(1, size), -1]
        self.height = pieces[:, 4].tolist() if pieces.shape[1] > 4 else [0.0] * size
        self.first, self.last = first, last
        self.alive = [True] * size

    def cost(self, i: int) -> float:
        """Of merging a cluster with the next."""
        j = self.right[i]
        return self.n[i] * self.n[j] / (self.n[i] + self.n[j]) * (self.mean[j] - self.mean[i]) ** 2

    def _may_merge(self, i: int, cost: float) -> bool:
        j = self.right[i]
        before, after = self.left[i], self.right[j]
        if (before < 0 and not self.first) or (after < 0 and not self.last):
            return False
        return (before < 0 or self.cost(before) > cost) and (after < 0 or self.cost(j) >= cost)

    def merge(self, keep: int, log: list[tuple] | None = None) -> list[tuple[float, float]]:
        """Merge all decided pairs; the ``keep`` dearest merges as (cost, border).

        ``log`` takes every merge as (lo, hi, n, mean, height, border, beyond): the new cluster, the dearest
        cost in it, the highest value of its left part and the lowest of its right part.
        """
        dearest: list[tuple[float, float]] = []
        heap = [(self.cost(i), i, self.right[i]) for i in range(len(self.n) - 1)]
        heapify(heap)
        while heap:
            cost, i, j = heappop(heap)
            if not self.alive[i] or self.right[i] != j or self.cost(i) != cost or not self._may_merge(i, cost):
                continue
            if keep:
                (heappush if len(dearest) < keep else heappushpop)(dearest, (cost, self.hi[i]))
            total = self.n[i] + self.n[j]
            self.mean[i] = (self.n[i] * self.mean[i] + self.n[j] * self.mean[j]) / total
            if log is not None:
                self.height[i] = max(cost, self.height[i], self.height[j])
                log.append((self.lo[i], self.hi[j], total, self.mean[i], self.height[i], self.hi[i], self.lo[j]))
            self.n[i], self.hi[i], self.right[i], self.alive[j] = total, self.hi[j], self.right[j], False
            if self.right[i] >= 0:
                self.left[self.right[i]] = i
            # the pairs beside the new cluster, and those beside them, may be decided now
            at = i
            for _ in range(2):
                at = self.left[at] if at >= 0 and self.left[at] >= 0 else at
            for _ in range(4):
                if at < 0 or self.right[at] < 0:
                    break
                heappush(heap, (self.cost(at), at, self.right[at]))
                at = self.right[at]
        return dearest

    def rest(self) -> list[tuple]:
        return [(self.lo[i], self.hi[i], self.n[i], self.mean[i]) for i in range(len(self.n)) if self.alive[i]]

    def rest_with_height(self) -> list[tuple]:
        return [(*piece, h) for piece, h in zip(self.rest(), (h for h, a in zip(self.height, self.alive) if a))]


def _ward_cuts(values: DataFrame, k: int, fan_in: int = 16) -> list[float]:
    """Upper borders of all but the last of k Ward clusters of the column ``x``.

    In one dimension a cluster is a stretch of values and every merge removes a border, so the
    k - 1 dearest merges of the whole run are the cuts. Stretches of the axis merge what they
    can decide by themselves; what is left of them goes on in ever fewer, longer stretches.
    """
    spark = values.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = values.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("n"))
    none = F.lit(None).cast("double")
    pieces = rows.select(F.col("x").alias("lo"), F.col("x").alias("hi"), "n", F.col("x").alias("mean"), none.alias("border"), none.alias("cost"))
    while True:
        lowest, highest, size = pieces.where("cost IS NULL").agg(F.min("lo"), F.max("hi"), F.count(F.lit(1))).first()
        if not size:
            return []

        def run(tables, lowest=lowest, highest=highest):
            batches = list(tables)
            if not batches:
                return
            table = pa.Table.from_batches(batches)
            merges = table.filter(pc.is_valid(table["cost"]))
            own = table.filter(pc.is_null(table["cost"])).select(["lo", "hi", "n", "mean"])
            dearest = list(zip(merges["cost"].to_pylist(), merges["border"].to_pylist()))
            rest = []
            if own.num_rows:
                data = np.stack([c.to_numpy() for c in own.columns], 1)
                chain = _Chain(data, data[0, 0] == lowest, data[-1, 1] == highest)
                dearest += chain.merge(k - 1)
                rest = chain.rest()
            out = [(*piece, None, None) for piece in rest]
            out += [(border, border, 0.0, border, border, cost) for cost, border in sorted(dearest)[-(k - 1) :]] if k > 1 else []
            yield pa.RecordBatch.from_pylist([dict(zip(_PIECE_SCHEMA.names, row)) for row in out], schema=_PIECE_SCHEMA)

        ranged = pieces.repartitionByRange(parts, "lo") if parts > 1 else pieces.coalesce(1)
        pieces = ranged.sortWithinPartitions("lo").mapInArrow(run, _PIECE).checkpoint()
        if parts == 1:
            break
        parts = max(1, parts // fan_in)
    cuts = pieces.where("cost IS NOT NULL").orderBy(F.desc("cost"), "border").limit(k - 1).select("border").collect()
    return sorted(r["border"] for r in cuts)


_PIECE_SCHEMA = pa.schema([(name, pa.float64()) for name in ("lo", "hi", "n", "mean", "border", "cost")])


def ward_labels(df: DataFrame, col: str, k: int = 3, out: str = "label") -> DataFrame:
    """Each row's Ward cluster, numbered by value: the exact merges of all values."""
    cuts = _ward_cuts(column_values(df, col), k)
    x = drop_nan(F.col(col))
    label = reduce(add, [(x > cut).cast("int") for cut in cuts], F.lit(0))
    return df.withColumn(out, F.when(x.isNotNull(), label))


_BRANCH = "lo double, hi double, n double, mean double, height double, border double, beyond double"
_BRANCH_SCHEMA = pa.schema([(part.split()[0], pa.float64()) for part in _BRANCH.split(", ")])


def _numbered_in_order(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Rows numbered from 0 by a total order: a range exchange, then the sizes of the ranges before."""
    ordered = df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()).checkpoint()
    rows = ordered.withColumn("__range", F.shiftright("__place", 33)).withColumn("__inside", F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))  # a row for each task
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__range", before.alias("__before"))
    return rows.join(F.broadcast(offsets), "__range").select(*df.columns, (F.col("__before") + F.col("__inside")).alias(out))


def ward_tree(df: DataFrame, col: str, fan_in: int = 16) -> DataFrame:
    """The whole merge tree: (step, left_lo, left_hi, right_lo, right_hi, left_step, right_step, cost, size).

    A row for each of the n - 1 merges of n distinct values, numbered from 0 by cost. A cluster is a
    stretch of values; ``left_step`` and ``right_step`` are the merges that made the two parts, null for
    a single value; ``size`` counts rows. The k clusters of any k are cut by ``left_hi`` of the last k - 1
    steps. Equal costs go in order of size, so that parts come before their whole; a merge never
    costs less than its parts. Missing values take no part; fewer than two values give no row.

    Stretches of the axis log the merges they can decide and pass on what is left, as ``ward_labels``
    does; logged merges are written at once and are not carried through later rounds.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None).cast("double")
    rest = column_values(df, col).groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rest = rest.select(F.col("x").alias("lo"), F.col("x").alias("hi"), "n", F.col("x").alias("mean"), F.lit(0.0).alias("height"), none.alias("border"), none.alias("beyond"))
    merges = rest.where(F.lit(False))
    while True:
        lowest, highest = rest.agg(F.min("lo"), F.max("hi")).first()
        if lowest is None:
            break

        def run(tables, lowest=lowest, highest=highest):
            batches = [b for b in tables if len(b)]
            if batches:
                data = np.stack([c.to_numpy() for c in pa.Table.from_batches(batches).columns[:5]], 1)
                chain, log = _Chain(data, data[0, 0] == lowest, data[-1, 1] == highest), []
                chain.merge(0, log)
                rows = [*((*piece, None, None) for piece in chain.rest_with_height()), *log]
                for at in range(0, len(rows), 50_000):
                    columns = zip(*rows[at : at + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in columns], schema=_BRANCH_SCHEMA)

        ranged = rest.repartitionByRange(parts, "lo") if parts > 1 else rest.coalesce(1)
        done = ranged.sortWithinPartitions("lo").mapInArrow(run, _BRANCH).checkpoint()
        merges = merges.unionAll(done.where("border IS NOT NULL"))
        rest = done.where("border IS NULL")
        if parts == 1:
            break
        parts = max(1, parts // fan_in)
    steps = _numbered_in_order(merges, ["height", "n", "lo"], "step")

    def made(part: str, lo: str, hi: str) -> DataFrame:
        """The step of each cluster of several values, under the names a parent knows its part by."""
        return steps.select(F.col("lo").alias(lo), F.col("hi").alias(hi), F.col("step").alias(f"{part}_step"))

    return (
        steps.join(made("left", "lo", "border"), ["lo", "border"], "left")
        .join(made("right", "beyond", "hi"), ["beyond", "hi"], "left")
        .select(
            "step", F.col("lo").alias("left_lo"), F.col("border").alias("left_hi"), F.col("beyond").alias("right_lo"),
            F.col("hi").alias("right_hi"), "left_step", "right_step", F.col("height").alias("cost"), F.col("n").cast("bigint").alias("size"),
        )
    )


def _nearest(x: Column, units: np.ndarray) -> Column:
    """Index of the nearest of the units, which are in order of value."""
    cuts = [(a + b) / 2 for a, b in zip(units, units[1:])]
    return reduce(add, [(x > float(cut)).cast("int") for cut in cuts], F.lit(0))


def self_organising_map(df: DataFrame, col: str, units: int = 10, sigma: float = 0.3, epochs: int = 20) -> DataFrame:
    """(unit, weight) of a batch-trained one-dimensional map.

    Per epoch one aggregate gives each unit's rows and sum; a unit moves to the mean of all
    units' rows, weighted by a normal kernel of the distance on the map.
    """
    values = column_values(df, col)
    facts = summarise(values)
    data = distinct_points(values).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        weights = facts.lo + (facts.hi - facts.lo) * (np.arange(units) + 0.5) / units
        place = np.arange(units)
        kernel = np.exp(-((place[:, None] - place[None, :]) ** 2) / (2 * sigma**2))
        for _ in range(epochs):
            rows = data.groupBy(_nearest(F.col("x"), weights).alias("unit")).agg(
                F.sum("w").alias("n"), F.sum(F.col("w") * F.col("x")).alias("s")
            ).collect()
            n, s = np.zeros(units), np.zeros(units)
            for row in rows:
                n[row["unit"]], s[row["unit"]] = row["n"], row["s"]
            held = kernel @ n
            moved = np.sort(np.where(held > 1e-12, (kernel @ s) / np.maximum(held, 1e-300), weights))
            settled = np.abs(moved - weights).max() <= 1e-9 * max(facts.hi - facts.lo, 1e-300)
            weights = moved
            if settled:
                break
        return df.sparkSession.createDataFrame(
            [(i, float(v)) for i, v in enumerate(weights)], "unit int, weight double"
        )
    finally:
        data.unpersist()
