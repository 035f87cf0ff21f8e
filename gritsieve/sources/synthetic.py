"""Random samples generated in parallel.

Randomness is a digest of a seed and a row's key, so a sample is the same for any partitioning,
after any retry and in any engine that has MD5.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BLOCK = 10_000


def uniform(key: Column, seed: int | Column, stream: int = 0) -> Column:
    """A number above 0 and up to 1 from 48 bits of a digest."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    digest = F.md5(F.concat_ws(":", seed.cast("string"), F.lit(str(stream)), key.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") + 1) / float(1 << 48)


def standard_normal(key: Column, seed: int | Column) -> Column:
    """A standard normal number for each key, by the polar form of two uniform ones."""
    return F.sqrt(-2 * F.log(uniform(key, seed, 1))) * F.cos(2 * F.pi() * uniform(key, seed, 2))


def normal_sample(spark: SparkSession, mean: float, sd: float, size: int, seed: int = 42) -> DataFrame:
    return spark.range(size).select((standard_normal(F.col("id"), seed) * sd + mean).alias("x"))


def add_noise(
    df: DataFrame, col: str, mean: float = 0.0, sd: float = 1.0, scale: float = 0.1, seed: int = 42, key: str | None = None
) -> DataFrame:
    """Add scaled normal noise; ``key`` names a unique column, without one a row's place in the input serves."""
    place = F.col(key) if key else F.monotonically_increasing_id()
    return df.withColumn(col, F.col(col) + scale * (standard_normal(place, seed) * sd + mean))


# Mean, standard deviation and size of the demonstration mixture.
MIXTURE = ((-5.0, 1.0, 1000), (0.0, 1.5, 1500), (5.0, 0.5, 500))


def component_rows(parts: DataFrame, seed: int = 42) -> DataFrame:
    """(component, i, x): the sample of a table of components (component, mean, sd, size).

    Components are cut into blocks before their rows are made, so a large one is no single task.
    """
    last = F.col("size") - 1
    blocks = parts.where("size > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / BLOCK))))
    count = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks.repartition(count, "component", "block").withColumn(
        "i", F.explode(F.sequence(F.col("block") * BLOCK, F.least(last, (F.col("block") + 1) * BLOCK - 1)))
    )
    drawn = standard_normal(F.col("i"), F.col("component") + seed)
    return rows.select("component", "i", (drawn * F.col("sd") + F.col("mean")).alias("x"))


def mixture_sample(
    spark: SparkSession, parts: Sequence[tuple[float, float, int]] = MIXTURE, seed: int = 42
) -> DataFrame:
    table = spark.createDataFrame(
        [(i, float(m), float(s), int(n)) for i, (m, s, n) in enumerate(parts)], "component int, mean double, sd double, size bigint"
    )
    return component_rows(table, seed).select("x")
