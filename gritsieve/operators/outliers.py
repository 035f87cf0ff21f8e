"""Isolation forest over one column.

In one dimension a forest's mean path length is a step function of the value. Every tree draws
its own rows from all of them, as many as the method prescribes; every row is then scored by
finding its step.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from gritsieve.functions.scalars import drop_nan
from gritsieve.operators.histogram import column_values

TREES = 100
TREE_ROWS = 256
CONTAMINATION = 0.1
EULER_GAMMA = 0.5772156649015329


def _usual_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n values."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + EULER_GAMMA) - 2 * (n - 1) / n


def _forest_steps(samples: list[np.ndarray], tree_rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Borders and the score of each of the intervals they make, from the values each tree drew."""
    rng = np.random.default_rng(seed)
    size = max(map(len, samples))
    depth_limit = math.ceil(math.log2(max(tree_rows, 2)))
    starts, jumps, trees = [], [], len(samples)
    for sample in samples:
        stack, before = [(0, len(sample), 0, -np.inf)], 0.0
        while stack:
            a, b, depth, start = stack.pop()
            low, high = sample[a], sample[b - 1]
            if b - a > 1 and depth < depth_limit and low < high:
                cut = rng.uniform(low, high)
                middle = a + int(np.searchsorted(sample[a:b], cut, "right"))
                if a < middle < b:
                    stack.append((middle, b, depth + 1, cut))
                    stack.append((a, middle, depth + 1, start))
                    continue
            path = depth + _usual_path(b - a)
            starts.append(start)
            jumps.append(path - before)
            before = path
    starts, jumps = np.array(starts), np.array(jumps)
    order = np.argsort(starts, kind="stable")
    borders, first = np.unique(starts[order], return_index=True)
    paths = np.cumsum(np.add.reduceat(jumps[order], first)) / trees
    return borders[1:], -(2.0 ** (-paths / max(_usual_path(size), 1e-12)))


def _tree_samples(values: DataFrame, trees: int, tree_rows: int, seed: int) -> list[np.ndarray]:
    """The sorted values of ``tree_rows`` rows for each tree, all rows if there are fewer.

    A row enters a tree's draw with a share that lets in somewhat more than ``tree_rows`` rows,
    of which those of lowest hash are kept: uniform over all rows, in any order of the input. As
    many trees as the share allows side by side share a hash of the row, so a large table costs
    one hash a row, and tasks send on only the drawn rows.
    """
    n = values.count()
    if not n:
        return []
    share = min(1.0, (tree_rows + 6 * math.sqrt(tree_rows) + 20) / n)
    together = max(1, int(1 / share))

    def unit(*parts):
        return F.xxhash64(F.lit(seed), *parts, F.col("__place")).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)

    def tree(turn):
        slot = F.floor(unit(F.lit("tree"), turn) / share)
        return F.when(slot < together, turn * together + slot)

    turns = F.sequence(F.lit(0), F.lit(-(-trees // together) - 1))
    entered = F.filter(F.transform(turns, tree), lambda t: t < trees)
    drawn = values.withColumn("__place", F.monotonically_increasing_id()).select("x", "__place", F.explode(entered).alias("tree"))
    order = Window.partitionBy("tree").orderBy(unit(F.lit("rank"), F.col("tree")), "x")
    rows = drawn.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= tree_rows).select("tree", "x").toPandas()
    return [np.sort(part.to_numpy()) for _, part in rows.groupby("tree")["x"]]


def isolation_scores(
    df: DataFrame, col: str, out: str = "score", trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 42
) -> DataFrame:
    """Score each row; the lower, the easier a value is to isolate.

    ``tree_rows`` rows per tree are the method's own parameter; they bound the table of steps
    that is broadcast.
    """
    spark = df.sparkSession
    samples = _tree_samples(column_values(df, col), trees, tree_rows, seed)
    if not samples:
        return df.withColumn(out, F.lit(None).cast("double"))
    borders, scores = _forest_steps(samples, tree_rows, seed)
    steps = spark.createDataFrame(pd.DataFrame({"__step": np.arange(len(scores), dtype=float), out: scores}))
    rows = df.withColumn("__x", drop_nan(F.col(col)))
    if len(borders):
        splits = [float("-inf"), *borders.tolist(), float("inf")]
        finder = Bucketizer(splits=splits, inputCol="__x", outputCol="__step", handleInvalid="keep")
        rows = finder.transform(rows)
    else:
        rows = rows.withColumn("__step", F.lit(0.0))
    scored = rows.join(F.broadcast(steps), "__step", "left")
    return scored.select(*df.columns, F.when(F.col("__x").isNotNull(), F.col(out)).alias(out))


def isolation_labels(
    df: DataFrame, col: str, contamination: float = CONTAMINATION, out: str = "label", **forest
) -> DataFrame:
    """-1 for the rows scored below the contamination quantile, 1 for the others."""
    scored = isolation_scores(df, col, "__score", **forest)
    # the steps bound the number of distinct scores, so the quantile works on a small table
    counts = scored.where("__score is not null").groupBy("__score").agg(F.count(F.lit(1)).alias("n"))
    limit = counts.agg(F.percentile("__score", contamination, F.col("n"))).first()[0]
    label = F.when(F.col("__score") < limit, -1).otherwise(1)
    return scored.withColumn(out, F.when(F.col("__score").isNotNull(), label)).drop("__score")
