"""Profile states: one small row per column that is written per batch and merged without reading rows again.

Counts, moments, extremes and the numbers of nulls merge exactly (moments to the last bits of a
double). Distinct numbers come from HyperLogLog sketches of 2**12 registers, whose relative error
is 1.6 % in one standard deviation; quantiles from KLL sketches of k = 400, whose rank error is
below 0.8 % with 99 % confidence, in a merged sketch as in one over all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

REGISTER_BITS = 12
KLL_SIZE = 400
QUANTILES = (0.25, 0.5, 0.75)


def column_states(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(column, n_rows, n, mean, m2, m3, m4, low, high, distinct, ranks) of numeric columns, in one aggregate.

    With ``by``, a state for each group of those columns (a day, a file, a batch), which stand in front.

    NaN counts as missing. ``m2`` to ``m4`` are sums of powers about the mean; a column without values
    has 0 and null sketches, an empty table one row of zeros per column.
    """
    typed = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    typed = typed.select(*by, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns])
    rows = []
    for name in columns:
        c = F.col(name)
        n, spread = F.count(c).cast("double"), F.sqrt(F.var_pop(c))
        rows.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                F.coalesce(F.var_pop(c) * n, F.lit(0.0)).alias("m2"),
                F.coalesce(F.nullif(F.skewness(c), F.lit(float("nan"))) * n * F.pow(spread, 3), F.lit(0.0)).alias("m3"),
                F.coalesce((F.nullif(F.kurtosis(c), F.lit(float("nan"))) + 3) * n * F.pow(spread, 4), F.lit(0.0)).alias("m4"),
                F.min(c).alias("low"),
                F.max(c).alias("high"),
                F.when(F.count(c) > 0, F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), F.lit(REGISTER_BITS))).alias("distinct"),
                F.when(F.count(c) > 0, F.kll_sketch_agg_double(c, F.lit(KLL_SIZE))).alias("ranks"),
            )
        )
    return typed.groupBy(*by).agg(F.array(*rows).alias("rows")).select(*by, F.inline("rows"))


def merge_states(states: DataFrame) -> DataFrame:
    """The state of all rows from the states of parts, in any grouping and order."""
    weight = F.col("n").cast("double")
    means = states.groupBy("column").agg((F.sum(F.col("mean") * weight) / F.sum(weight)).alias("all_mean"))
    moved = states.join(means, "column").withColumn("d", F.coalesce(F.col("mean") - F.col("all_mean"), F.lit(0.0)))
    d, m2, m3 = F.col("d"), F.col("m2"), F.col("m3")
    return moved.groupBy("column").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n").alias("n"),
        F.first("all_mean").alias("mean"),
        F.sum(m2 + weight * d**2).alias("m2"),
        F.sum(m3 + 3 * d * m2 + weight * d**3).alias("m3"),
        F.sum(F.col("m4") + 4 * d * m3 + 6 * d**2 * m2 + weight * d**4).alias("m4"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.when(F.sum("n") > 0, F.hll_union_agg("distinct")).alias("distinct"),
        F.when(F.sum("n") > 0, F.kll_merge_agg_double("ranks")).alias("ranks"),
    )


def profile_of(states: DataFrame) -> DataFrame:
    """The profile of each column from its merged state; exact but for ``n_unique`` and the quantiles."""
    n = F.col("n").cast("double")
    variance = F.when(F.col("n") > 1, F.col("m2") / (n - 1))
    spread = F.col("m2") / n
    skewness = F.when(n < 3, None).when(F.col("m2") == 0, 0.0).otherwise(F.col("m3") / n / F.pow(spread, 1.5) * F.sqrt(n * (n - 1)) / (n - 2))
    excess = F.col("m4") / n / spread**2 - 3
    kurtosis = F.when(n < 4, None).when(F.col("m2") == 0, 0.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * excess + 6))
    quantiles = [F.kll_sketch_get_quantile_double("ranks", F.lit(q)).alias(name) for q, name in zip(QUANTILES, ("q25", "median", "q75"))]
    return states.select(
        "column",
        F.col("n").alias("count"),
        (F.col("n_rows") - F.col("n")).alias("missing"),
        "mean",
        F.sqrt(variance).alias("std"),
        variance.alias("variance"),
        skewness.alias("skewness"),
        kurtosis.alias("kurtosis"),
        F.col("low").alias("min"),
        F.col("high").alias("max"),
        (F.col("high") - F.col("low")).alias("range"),
        F.coalesce(F.hll_sketch_estimate("distinct"), F.lit(0)).alias("n_unique"),
        *quantiles,
    )
