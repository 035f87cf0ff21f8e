"""Exact density clustering of one column, without comparing all pairs of rows.

The line is cut into cells a hair narrower than ``eps``. All values of a cell are in reach
of each other, so a cell with ``min_samples`` rows consists of core values of one cluster,
however many they are. Only the few values of thinner cells must be compared with others,
and of any neighbouring cell its ``min_samples`` lowest and highest values suffice to decide.
Clusters are runs of cells whose facing core values are in reach.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window, functions as F

from gritsieve.functions.scalars import drop_nan
from gritsieve.operators.groups import lookup, running_total
from gritsieve.operators.histogram import column_values
from gritsieve.session import ensure_checkpoint_dir

NOISE = -1
SHRINK = 1 - 1e-9
NEIGHBOURS = (-2, -1, 0, 1, 2)


EXACT = float(1 << 52)  # above it a double has no fraction


def _cell(x, eps: float):
    """The cell's number as a double, which holds for values of any size."""
    place = x / (eps * SHRINK)
    near = F.abs(place) < EXACT
    return F.when(near, F.floor(F.when(near, place)).cast("double")).otherwise(place)


def _edge_values(points: DataFrame, k: int) -> DataFrame:
    """The k lowest and k highest distinct values of every cell; pruned before the shuffle."""
    ends = []
    for order in (F.asc("x"), F.desc("x")):
        rank = F.row_number().over(Window.partitionBy("cell").orderBy(order))
        ends.append(points.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))
    return ends[0].unionAll(ends[1]).dropDuplicates(["cell", "x"])


def _near(points: DataFrame, others: DataFrame, eps: float) -> DataFrame:
    """Pairs of a point and one of the others within eps, found through neighbouring cells."""
    asked = points.withColumn("at", F.explode(F.array_distinct(F.array(*[F.col("cell") + float(d) for d in NEIGHBOURS]))))
    other = others.select(F.col("cell").alias("at"), F.col("x").alias("y"), F.col("w").alias("v"))
    return asked.join(other, "at").where(F.abs(F.col("y") - F.col("x")) <= eps)


def dbscan_labels(
    df: DataFrame, col: str, eps: float = 0.5, min_samples: int = 5, out: str = "label"
) -> DataFrame:
    """Each row's cluster, numbered by value; -1 for noise and infinite values, null for missing ones.

    A value that is no core value joins the cluster of its nearest core value in reach.
    """
    ensure_checkpoint_dir(df.sparkSession)
    values = column_values(df, col).where(F.abs("x") < float("inf"))
    points = values.groupBy("x").agg(F.count(F.lit(1)).alias("w")).withColumn("cell", _cell(F.col("x"), eps))
    sizes = points.groupBy("cell").agg(F.sum("w").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).checkpoint()
    edges = _edge_values(points, min_samples).join(sizes.select("cell", "n"), "cell").checkpoint()

    # values of thin cells: all of them are edge values
    thin = edges.where(F.col("n") < min_samples)
    reach = _near(thin, edges, eps).groupBy("cell", "x").agg((F.sum("v") >= min_samples).alias("core"))
    tested = thin.join(reach, ["cell", "x"]).checkpoint()
    core_values = edges.where(F.col("n") >= min_samples).select("cell", "x", "w").unionAll(
        tested.where("core").select("cell", "x", "w")
    )

    dense = sizes.where(F.col("n") >= min_samples).select("cell", "lo", "hi")
    sparse = tested.where("core").groupBy("cell").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    core_cells = dense.unionAll(sparse)
    moved = lambda d: core_cells.where(F.col("cell") + float(d) != F.col("cell"))
    left = [moved(d).select((F.col("cell") + float(d)).alias("cell"), F.col("hi").alias(f"hi{d}")) for d in (1, 2)]
    linked = core_cells.join(left[0], "cell", "left").join(left[1], "cell", "left")
    joined = reduce(or_, [F.coalesce(F.col("lo") - F.col(f"hi{d}") <= eps, F.lit(False)) for d in (1, 2)])
    starts = linked.select("cell", (~joined).cast("bigint").alias("start"))
    clusters = running_total(starts, "cell", "start", "cluster").select(
        "cell", (F.col("cluster") - 1).alias("cluster")
    ).checkpoint()

    # the other values of thin cells: nearest core value, the lower one on a tie
    nearest = F.min(F.struct(F.abs(F.col("y") - F.col("x")).alias("gap"), F.col("y"), F.col("at")))
    border = _near(tested.where("not core"), core_values, eps).groupBy("x").agg(nearest["at"].alias("cell"))
    core_thin = tested.where("core").select("x", "cell")
    thin_labels = (
        border.unionAll(core_thin).join(clusters, "cell").select(F.col("x").alias("__value"), F.col("cluster").alias("__thin"), F.lit(1).alias("__rows"))
    )

    dense_labels = sizes.where(F.col("n") >= min_samples).join(clusters, "cell").select(
        F.col("cell").alias("__cell"), F.col("cluster").alias("__dense"), "n"
    )
    rows = df.withColumn("__x", drop_nan(F.col(col))).withColumn("__cell", F.when(F.abs("__x") < float("inf"), _cell(F.col("__x"), eps)))
    rows = lookup(rows, dense_labels, ["__cell"], ["__dense"], "n", nulls_equal=False)
    # only values of thin cells are looked up: each has fewer than min_samples rows, and the others are spread
    rows = rows.withColumn("__value", F.when(F.col("__dense").isNull() & F.col("__cell").isNotNull(), F.col("__x")))
    rows = lookup(rows, thin_labels, ["__value"], ["__thin"], "__rows", nulls_equal=False)
    label = F.coalesce("__dense", "__thin", F.lit(NOISE)).cast("bigint")
    return rows.select(*df.columns, F.when(F.col("__x").isNotNull(), label).alias(out))
