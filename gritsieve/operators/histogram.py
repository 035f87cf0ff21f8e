"""Histograms, their peaks and two-dimensional bin counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gritsieve.functions.scalars import drop_nan, normal_pdf
from gritsieve.operators.groups import with_group_facts

BINS = 50
GRID = 1000


def column_values(df: DataFrame, col: str) -> DataFrame:
    """One double column ``x`` without missing values."""
    return df.select(drop_nan(F.col(col)).alias("x")).where("x is not null")


@dataclass(frozen=True)
class Summary:
    """Range, size and moments of a column: one row fetched by one aggregate."""

    lo: float
    hi: float
    n: int
    mean: float
    sd: float

    def edges(self, bins: int) -> tuple[float, float]:
        """Left edge and bin width; a constant column gets width one around its value."""
        if self.lo == self.hi:
            return self.lo - 0.5, 1.0 / bins
        return self.lo, (self.hi - self.lo) / bins


def summarise(values: DataFrame, weight: str | None = None) -> Summary:
    n = F.count("x") if weight is None else F.sum(weight)
    row = values.agg(F.min("x"), F.max("x"), n, F.avg("x"), F.stddev_samp("x")).first()
    if row[0] is None:
        raise ValueError("the column has no values")
    return Summary(row[0], row[1], int(row[2]), row[3], row[4] or 0.0)


def _bin(x: Column, start, width, bins: int) -> Column:
    """Bin number; the last bin is closed."""
    return F.least(F.floor((x - start) / width), F.lit(bins - 1)).cast("bigint")


def histogram(df: DataFrame, col: str, bins: int = BINS) -> DataFrame:
    """All bins, empty ones too: (bin, left_edge, n, density)."""
    values = column_values(df, col)
    facts = summarise(values)
    start, width = facts.edges(bins)
    counts = values.groupBy(_bin(F.col("x"), F.lit(start), F.lit(width), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    n = F.coalesce("n", F.lit(0))
    return every.join(counts, "bin", "left").select(
        "bin", (start + F.col("bin") * width).alias("left_edge"), n.alias("n"), (n / (facts.n * width)).alias("density")
    )


def group_histogram(df: DataFrame, col: str, group: str, bins: int = BINS) -> DataFrame:
    """A histogram per group over the group's own range."""
    values = df.select(F.col(group).alias("group"), drop_nan(F.col(col)).alias("x")).where("x is not null")
    facts = {"lo": F.min("x"), "hi": F.max("x"), "total": F.count("x")}
    constant = F.col("lo") == F.col("hi")
    start = F.when(constant, F.col("lo") - 0.5).otherwise(F.col("lo"))
    width = F.when(constant, F.lit(1.0)).otherwise(F.col("hi") - F.col("lo")) / bins
    rows = with_group_facts(values, ["group"], facts)
    counts = rows.groupBy(F.col("group").alias("__group"), _bin(F.col("x"), start, width, bins).alias("__bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    summary = values.groupBy("group").agg(*[c.alias(k) for k, c in facts.items()])
    every = summary.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    match = every["group"].eqNullSafe(counts["__group"]) & (every["bin"] == counts["__bin"])
    n = F.coalesce("n", F.lit(0))
    return every.join(counts, match, "left").select(
        "group", "bin", (start + F.col("bin") * width).alias("left_edge"), n.alias("n"), (n / (F.col("total") * width)).alias("density")
    )


def peaks(curve: DataFrame, position: str, height: str) -> DataFrame:
    """Strict local maxima of a bounded curve; of a plateau its middle; never the ends.

    ``position`` numbers the points 0, 1, ... and the curve has at most some thousand points,
    so ordering it in one task is fine.
    """
    along = Window.orderBy(position)
    back = along.rowsBetween(Window.unboundedPreceding, 0)
    ahead = along.rowsBetween(0, Window.unboundedFollowing)
    marked = curve.select(
        "*", F.lag(height).over(along).alias("__previous"), F.lead(height).over(along).alias("__next")
    )
    starts = F.coalesce(F.col("__previous") != F.col(height), F.lit(True))
    ends = F.coalesce(F.col("__next") != F.col(height), F.lit(True))
    at = F.struct(F.col(position).alias("at"), F.col("__previous").alias("beside"))
    to = F.struct(F.col(position).alias("at"), F.col("__next").alias("beside"))
    runs = marked.select(
        "*",
        F.last(F.when(starts, at), ignorenulls=True).over(back).alias("__start"),
        F.first(F.when(ends, to), ignorenulls=True).over(ahead).alias("__end"),
    )
    middle = F.floor((F.col("__start.at") + F.col("__end.at")) / 2)
    higher = (F.col(height) > F.col("__start.beside")) & (F.col(height) > F.col("__end.beside"))
    return runs.where((F.col(position) == middle) & higher).select(*curve.columns)


def histogram_peaks(df: DataFrame, col: str, bins: int = BINS) -> DataFrame:
    return peaks(histogram(df, col, bins), "bin", "density").select("bin", "left_edge", "density")


def grid_points(df: DataFrame, facts: Summary, size: int = GRID) -> DataFrame:
    """(i, x): equally spaced points from the lowest to the highest value."""
    step = (facts.hi - facts.lo) / (size - 1)
    x = F.when(F.col("id") == size - 1, F.lit(facts.hi)).otherwise(facts.lo + F.col("id") * step)
    return df.sparkSession.range(size).select(F.col("id").alias("i"), x.alias("x"))


def distribution_with_normal(
    df: DataFrame,
    col: str,
    mean: float | None = None,
    sd: float | None = None,
    scale: float = 1.0,
    bins: int = BINS,
    size: int = GRID,
) -> DataFrame:
    """Histogram density and normal curve as (kind, i, x, density)."""
    facts = summarise(column_values(df, col))
    bars = histogram(df, col, bins).select(
        F.lit("histogram").alias("kind"), F.col("bin").alias("i"), F.col("left_edge").alias("x"), "density"
    )
    density = normal_pdf(F.col("x"), facts.mean if mean is None else mean, facts.sd if sd is None else sd, scale)
    curve = grid_points(df, facts, size).select(F.lit("normal").alias("kind"), "i", "x", density.alias("density"))
    return bars.unionByName(curve)


def pairwise_bins(df: DataFrame, columns: Sequence[str], bins: int = 20) -> DataFrame:
    """Bin counts of each column and each pair: (x_col, y_col, x_bin, y_bin, n, density).

    All columns' ranges come from one aggregate and all counts from one more. Diagonal rows
    have equal columns and bins and carry the column's density.
    """
    clean = df.select(*[drop_nan(F.col(c)).alias(c) for c in columns])
    wanted = [f(c).alias(f"{p}{i}") for i, c in enumerate(columns) for p, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]
    row = clean.agg(*wanted).first()
    facts = {c: Summary(row[f"lo{i}"], row[f"hi{i}"], row[f"n{i}"], 0.0, 0.0) for i, c in enumerate(columns) if row[f"n{i}"]}
    binned = clean.select(
        *[_bin(F.col(c), *map(F.lit, facts[c].edges(bins)), bins).alias(c) for c in facts]
    )
    pairs = [*((c, c) for c in facts), *combinations(facts, 2)]
    cells = []
    for a, b in pairs:
        area = F.lit(1.0 / (facts[a].n * facts[a].edges(bins)[1])) if a == b else F.lit(None).cast("double")
        cells.append(
            F.struct(
                F.lit(a).alias("x_col"), F.lit(b).alias("y_col"),
                F.col(a).alias("x_bin"), F.col(b).alias("y_bin"), area.alias("unit"),
            )
        )
    return (
        binned.select(F.explode(F.array(*cells)).alias("cell"))
        .where("cell.x_bin is not null and cell.y_bin is not null")
        .groupBy("cell.x_col", "cell.y_col", "cell.x_bin", "cell.y_bin")
        .agg(F.count(F.lit(1)).alias("n"), F.max("cell.unit").alias("unit"))
        .withColumn("density", F.col("n") * F.col("unit"))
        .drop("unit")
    )
