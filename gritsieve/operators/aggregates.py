"""Column statistics. All statistics of all columns come from one aggregate where possible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gritsieve.operators.quantiles import quantile_columns


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("columns"))


def null_percent(c: Column) -> Column:
    """Rounded percentage of nulls, ties to even; null for an empty table."""
    rows = F.nullif(F.count(F.lit(1)), F.lit(0))
    return F.bround(100 * F.count_if(c.isNull()) / rows).cast("bigint")


def skewness(c: Column) -> Column:
    """Bias-corrected skewness; null below three values, zero for constants."""
    n = F.count(c)
    corrected = F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, None).when(F.var_pop(c) == 0, 0.0).otherwise(corrected)


def kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values, zero for constants."""
    n = F.count(c).cast("double")
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)
    return F.when(n < 4, None).when(F.var_pop(c) == 0, 0.0).otherwise(corrected)


def long_values(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """(column, value) rows of the named columns, values cast to one type."""
    typed = df.select(*[F.col(c).cast(kind).alias(c) for c in columns])
    return typed.unpivot([], list(columns), "column", "value")


def frequencies(df: DataFrame, columns: Sequence[str], kind: str = "string") -> DataFrame:
    """(column, value, n) of the non-null values, pre-aggregated before the shuffle."""
    return long_values(df, columns, kind).where("value is not null").groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def value_counts(df: DataFrame, col: str, k: int | None = 10) -> DataFrame:
    """The k most frequent values; equal counts by value."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.orderBy(F.desc("n"), F.asc(col))
    return ordered if k is None else ordered.limit(k)


def distinct_and_mode(df: DataFrame, columns: Sequence[str], kind: str = "double") -> DataFrame:
    """Per column: number of distinct values, smallest most frequent value and its count."""
    top = F.min(F.struct((-F.col("n")).alias("n"), F.col("value")))
    return frequencies(df, columns, kind).groupBy("column").agg(
        F.count(F.lit(1)).alias("n_unique"), top["value"].alias("mode"), (-top["n"]).alias("mode_count")
    )


NUMERIC_FACTS = (
    "count", "missing", "mean", "median", "std", "variance", "skewness", "kurtosis", "min", "max", "range", "q25", "q75", "iqr",
)
_QUANTILE_FACTS = {"median", "q25", "q75", "iqr"}


def numeric_facts(c: Column, quantile: dict[float, Column]) -> dict[str, Column]:
    low, high = F.min(c), F.max(c)
    facts = {
        "count": F.count(c),
        "missing": F.count_if(c.isNull()),
        "mean": F.avg(c),
        "std": F.stddev_samp(c),
        "variance": F.var_samp(c),
        "skewness": skewness(c),
        "kurtosis": kurtosis(c),
        "min": low.cast("double"),
        "max": high.cast("double"),
        "range": (high - low).cast("double"),
    }
    if quantile:
        q25, q50, q75 = (quantile[q] for q in (0.25, 0.5, 0.75))
        facts |= {"median": q50, "q25": q25, "q75": q75, "iqr": q75 - q25}
    return facts


def numeric_stats(df: DataFrame, columns: Sequence[str], facts: Sequence[str] = NUMERIC_FACTS) -> DataFrame:
    """One row of the named statistics per numeric column; all columns share each pass over the table."""
    typed = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    typed = typed.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns])
    shares = (0.25, 0.5, 0.75) if _QUANTILE_FACTS & set(facts) else ()
    found = None
    if shares:
        # apart from the other aggregates, which compile to one loop
        quantiles = quantile_columns(typed, columns, shares)
        picks = [quantiles[c, q].alias(f"q{i}_{j}") for i, c in enumerate(columns) for j, q in enumerate(shares)]
        found = typed.agg(*picks).first()
    rows = []
    for i, c in enumerate(columns):
        own = numeric_facts(F.col(c), {q: F.lit(found[f"q{i}_{j}"]).cast("double") for j, q in enumerate(shares)})
        rows.append(F.struct(F.lit(c).alias("column"), *[own[name].alias(name) for name in facts]))
    return typed.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def abs_zscores(df: DataFrame, col: str, out: str = "abs_z") -> DataFrame:
    """|z| of each value by the population deviation; nulls stay null, constants give zero."""
    fit = df.agg(F.struct(F.avg(col).alias("m"), F.stddev_pop(col).alias("s"))).scalar()
    spread = F.coalesce(F.nullif(fit["s"], F.lit(0.0)), F.lit(1.0))
    return df.withColumn(out, F.abs((F.col(col) - fit["m"]) / spread))


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    stats = numeric_stats(df, columns, ("count", "mean", "std", "min", "q25", "median", "q75", "max"))
    return stats.withColumnRenamed("median", "q50")


def describe_text(df: DataFrame, columns: Sequence[str], bad: Column | None = None) -> DataFrame:
    """count, unique, most frequent value (smallest on a tie) and its frequency.

    ``bad``, a test of (column, value), adds the numbers of bad and of distinct bad values; it is made once for each distinct value.
    """
    top = F.min(F.struct((-F.col("n")).alias("n"), F.col("value")))
    values, faults = frequencies(df, columns), {}
    if bad is not None:
        values = values.withColumn("bad", bad)
        faults = {"n_invalid": F.sum(F.when(F.col("bad"), F.col("n"))), "n_distinct_bad": F.count_if("bad")}
    seen = values.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        top["value"].alias("top"), (-top["n"]).alias("freq"), *[f.alias(n) for n, f in faults.items()],
    )
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(seen, "column", "left").select(
        "column", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("unique", F.lit(0)).alias("unique"), "top", "freq",
        *[F.coalesce(n, F.lit(0)).alias(n) for n in faults],
    )


def all_valid(c: Column, valid: Column) -> Column:
    """Do all non-null values satisfy the test? True for a column without values."""
    return F.coalesce(F.every(F.when(c.isNotNull(), valid)), F.lit(True))


def null_counts(df: DataFrame) -> dict[str, int]:
    """Rows (key '') and nulls per column, from one pass; the result is one small row."""
    facts = [F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]]
    row = df.agg(*facts).first()
    return {"": row["rows"], **{c: row["rows"] - row[f"c{i}"] for i, c in enumerate(df.columns)}}
