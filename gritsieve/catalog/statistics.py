"""Queries over aggregates, profiles and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritsieve.catalog.base import MESSY_SCHEMA, VALID_SQL, float_sql, integer_sql, messy, over_messy, query, tagged
from gritsieve.operators import aggregates as agg, duplicates, profile, scaling, states
from gritsieve.operators.histogram import histogram
from gritsieve.operators.preview import grid
from gritsieve.operators.quality import distinct_rejects
from gritsieve.sources.files import read_table, spread

c = F.col

LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def significant(x):
    """Nine digits after the first: a variance may be too large for fixed decimals."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    return F.when(x > 0, F.round(x / power, 9) * power).otherwise(x)


def significant_sql(x: str) -> str:
    power = f"pow(10.0::DOUBLE, floor(log10({x})))"
    return f"CASE WHEN {x} > 0 THEN round({x} / {power}, 9) * {power} ELSE {x} END"


def rounded(df, digits: int = 4):
    """Doubles rounded, so that the engines' last bits do not matter."""
    shown = {n: significant(c(n)) if n == "variance" else F.round(n, digits) for n, t in df.dtypes if t == "double"}
    return df.select(*[shown[n].alias(n) if n in shown else c(n) for n in df.columns])


def _moment(x: str, table: str) -> str:
    """Count and central moments of an expression."""
    return f"(SELECT count(x) AS n, avg((x - m) ** 2) AS m2, avg((x - m) ** 3) AS m3, avg((x - m) ** 4) AS m4 FROM (SELECT {x} AS x, avg({x}) OVER () AS m FROM {table}))"


def stats_sql(x: str, table: str, label: str, name: str = "column_name") -> str:
    """One row with all statistics of a numeric expression."""
    return (
        f"SELECT '{label}' AS {name}, s.*, "
        "CASE WHEN p.n >= 3 THEN CASE WHEN p.m2 = 0 THEN 0 ELSE round(p.m3 / p.m2 ** 1.5 * sqrt(p.n * (p.n - 1)) / (p.n - 2), 4) END END AS skewness, "
        "CASE WHEN p.n >= 4 THEN CASE WHEN p.m2 = 0 THEN 0 ELSE round((p.n - 1.0) / ((p.n - 2.0) * (p.n - 3.0)) * ((p.n + 1) * (p.m4 / p.m2 ** 2 - 3) + 6), 4) END END AS kurtosis "
        f"FROM (SELECT count({x}) AS \"count\", count(*) - count({x}) AS missing, round(avg({x}), 4) AS mean, round(quantile_cont({x}, 0.5), 4) AS median, "
        f"round(stddev_samp({x}), 4) AS std, {significant_sql(f'var_samp({x})')} AS variance, round(CAST(min({x}) AS DOUBLE), 4) AS min, round(CAST(max({x}) AS DOUBLE), 4) AS max, "
        f"round(CAST(max({x}) - min({x}) AS DOUBLE), 4) AS range, round(quantile_cont({x}, 0.25), 4) AS q25, round(quantile_cont({x}, 0.75), 4) AS q75, "
        f"round(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25), 4) AS iqr FROM {table}) s, {_moment(x, table)} p"
    )


def unique_sql(x: str, table: str) -> str:
    return (
        f"(SELECT count(DISTINCT {x}) FROM {table}) AS n_unique, "
        f"(SELECT CAST({x} AS DOUBLE) FROM {table} WHERE {x} IS NOT NULL GROUP BY {x} ORDER BY count(*) DESC, {x} LIMIT 1) AS mode"
    )


def _lines(spark, folder, *columns):
    return spread(read_table(spark, folder, "lineitem"), "l_orderkey").select(*columns)


# -- aggregates --------------------------------------------------------------------------
@query("agg_1", over_messy("SELECT count(*) AS rows, CAST(13 AS BIGINT) AS columns FROM messy"))
def agg_1(spark, folder):
    return agg.shape(messy(spark, folder))


def _null_percent_sql(n: str) -> str:
    return f"CAST(round_even(100.0 * count(*) FILTER (WHERE {n} IS NULL) / count(*), 0) AS BIGINT) AS {n}"


_SPARSE = ("id", "flag", "items", "homepage", "note", "blank")


@query("agg_2", over_messy("SELECT " + ", ".join(_null_percent_sql(n) for n in _SPARSE) + " FROM messy"))
def agg_2(spark, folder):
    return messy(spark, folder).agg(*[agg.null_percent(c(n)).alias(n) for n in _SPARSE])


@query("agg_3", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_shipdate) AS days FROM lineitem")
def agg_3(spark, folder):
    counts = agg.frequencies(_lines(spark, folder, "l_partkey", "l_suppkey", "l_shipdate"), ["l_partkey", "l_suppkey", "l_shipdate"])
    pick = lambda n: F.count_if(c("column") == n)
    return counts.agg(pick("l_partkey").alias("parts"), pick("l_suppkey").alias("suppliers"), pick("l_shipdate").alias("days"))


@query("agg_4", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 10")
def agg_4(spark, folder):
    return agg.value_counts(read_table(spark, folder, "lineitem"), "l_partkey", 10)


def _one_per_column(sql):
    return " UNION ALL ".join(f"SELECT '{n}' AS column_name, {sql(n)} FROM lineitem" for n in LINE_NUMBERS)


def _stats(spark, folder, *facts):
    stats = agg.numeric_stats(_lines(spark, folder, *LINE_NUMBERS), LINE_NUMBERS, facts)
    return rounded(stats.withColumnRenamed("column", "column_name"))


@query("agg_5", _one_per_column(lambda n: f"round(avg({n}), 4) AS mean"))
def agg_5(spark, folder):
    return _stats(spark, folder, "mean")


@query("agg_6", _one_per_column(lambda n: f"round(median({n}), 4) AS median"))
def agg_6(spark, folder):
    return _stats(spark, folder, "median")


@query("agg_7", " UNION ALL ".join(f"SELECT '{n}' AS column_name, {unique_sql(n, 'lineitem')}" for n in LINE_NUMBERS))
def agg_7(spark, folder):
    found = agg.distinct_and_mode(_lines(spark, folder, *LINE_NUMBERS), LINE_NUMBERS)
    return found.select(c("column").alias("column_name"), "n_unique", "mode")


@query("agg_8", _one_per_column(lambda n: f"round(stddev_samp({n}), 4) AS std"))
def agg_8(spark, folder):
    return _stats(spark, folder, "std")


def _pick_sql(fact: str) -> str:
    return " UNION ALL ".join(f"SELECT column_name, {fact} FROM ({stats_sql(n, 'lineitem', n)})" for n in LINE_NUMBERS)


@query("agg_9", _pick_sql("skewness"))
def agg_9(spark, folder):
    return _stats(spark, folder, "skewness")


@query("agg_10", _pick_sql("kurtosis"))
def agg_10(spark, folder):
    return _stats(spark, folder, "kurtosis")


@query("agg_11", "SELECT event_id, round(abs((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events)), 6) AS abs_z FROM events")
def agg_11(spark, folder):
    scored = agg.abs_zscores(read_table(spark, folder, "events"), "value")
    return scored.select("event_id", F.round("abs_z", 6).alias("abs_z"))


@query("agg_12", _pick_sql("min, max, range"))
def agg_12(spark, folder):
    return _stats(spark, folder, "min", "max", "range")


@query("agg_13", _one_per_column(lambda n: f"{significant_sql(f'var_samp({n})')} AS variance"))
def agg_13(spark, folder):
    return _stats(spark, folder, "variance")


@query("agg_14", _pick_sql("q25, q75, iqr"))
def agg_14(spark, folder):
    return _stats(spark, folder, "q25", "q75", "iqr")


@query("agg_15", over_messy("SELECT " + ", ".join(f"count(*) - count({n}) AS {n}" for n in MESSY_SCHEMA.columns) + " FROM messy"))
def agg_15(spark, folder):
    return messy(spark, folder).agg(*[F.count_if(c(n).isNull()).alias(n) for n in MESSY_SCHEMA.columns])


_DESCRIBED = tuple(MESSY_SCHEMA.columns)


@query(
    "agg_16",
    over_messy(
        " UNION ALL ".join(
            f"SELECT '{n}' AS column_name, count({n}) AS \"count\", count(DISTINCT {n}) AS \"unique\", "
            f"(SELECT {n} FROM messy WHERE {n} IS NOT NULL GROUP BY {n} ORDER BY count(*) DESC, {n} LIMIT 1) AS top, "
            f"(SELECT count(*) FROM messy WHERE {n} IS NOT NULL GROUP BY {n} ORDER BY count(*) DESC, {n} LIMIT 1) AS freq FROM messy"
            for n in _DESCRIBED
        )
    ),
)
def agg_16(spark, folder):
    return agg.describe_text(messy(spark, folder), _DESCRIBED).withColumnRenamed("column", "column_name")


@query("agg_17", "SELECT o_orderpriority, CAST(round(avg(o_totalprice)) AS BIGINT) AS average FROM orders GROUP BY o_orderpriority")
def agg_17(spark, folder):
    return read_table(spark, folder, "orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice")).cast("bigint").alias("average"))


@query("agg_18", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_18(spark, folder):
    return read_table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("agg_19", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25")
def agg_19(spark, folder):
    return read_table(spark, folder, "lineitem").where("l_quantity > 25").agg(F.count(F.lit(1)).alias("n"))


@query("agg_20", "SELECT min(n) AS fewest, max(n) AS most FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def agg_20(spark, folder):
    counts = read_table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min("n").alias("fewest"), F.max("n").alias("most"))


@query("agg_21", over_messy("SELECT " + ", ".join(f"coalesce(bool_and(({VALID_SQL[n]}) IS NOT NULL) FILTER (WHERE {n} IS NOT NULL), true) AS {n}" for n in MESSY_SCHEMA.columns) + " FROM messy"))
def agg_21(spark, folder):
    facts = [agg.all_valid(c(n), MESSY_SCHEMA.extractor(n)(c(n)).isNotNull()).alias(n) for n in MESSY_SCHEMA.columns]
    return messy(spark, folder).agg(*facts)


@query("agg_22", over_messy(f"SELECT 'status' AS column_name, status AS value, count(*) AS n_rows FROM messy WHERE status IS NOT NULL AND ({VALID_SQL['status']}) IS NULL GROUP BY status"))
def agg_22(spark, folder):
    bad = distinct_rejects(messy(spark, folder).select("status"), MESSY_SCHEMA)
    return bad.select(c("column").alias("column_name"), "value", "n_rows")


@query("agg_23", "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus, o_orderpriority)")
def agg_23(spark, folder):
    return duplicates.duplicate_count(read_table(spark, folder, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query("agg_24", over_messy(" UNION ALL ".join(f"SELECT '{n}' AS column_name, count({n}) = 0 AS blank, count(*) - count({n}) > 0.5 * count(*) AS sparse FROM messy" for n in MESSY_SCHEMA.columns)))
def agg_24(spark, folder):
    facts = [
        F.struct(
            F.lit(n).alias("column_name"),
            (F.count(n) == 0).alias("blank"),
            (F.count_if(c(n).isNull()) > 0.5 * F.count(F.lit(1))).alias("sparse"),
        )
        for n in MESSY_SCHEMA.columns
    ]
    return messy(spark, folder).agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


# -- profiles ----------------------------------------------------------------------------
@query(
    "prf_1",
    " UNION ALL ".join(f"SELECT a.*, {unique_sql(n, 'lineitem')} FROM ({stats_sql(n, 'lineitem', n)}) a" for n in LINE_NUMBERS),
)
def prf_1(spark, folder):
    found = profile.numeric_profile(_lines(spark, folder, *LINE_NUMBERS), LINE_NUMBERS)
    return rounded(found).withColumnRenamed("column", "column_name")


_EXACT_STATE = ("count", "missing", "mean", "std", "variance", "skewness", "kurtosis", "min", "max", "range")


@query("prf_1_states", " UNION ALL ".join(f"SELECT column_name, {', '.join(f'{chr(34)}{f}{chr(34)}' for f in _EXACT_STATE)} FROM ({stats_sql(n, 'lineitem', n)}) a" for n in LINE_NUMBERS))
def prf_1_states(spark, folder):
    """The numeric profile merged from the states of seven parts; its exact columns (a test bounds the others)."""
    lines = _lines(spark, folder, *LINE_NUMBERS, "l_orderkey").withColumn("part", F.pmod("l_orderkey", F.lit(7)))
    merged = states.merge_states(states.column_states(lines, LINE_NUMBERS, by=["part"]))
    return rounded(states.profile_of(merged).select("column", *_EXACT_STATE)).withColumnRenamed("column", "column_name")


_PROFILED = tuple(MESSY_SCHEMA.columns)


def _text_profile_sql(n: str) -> str:
    bad = f"{n} IS NOT NULL AND ({VALID_SQL[n]}) IS NULL"
    return (
        f"SELECT '{n}' AS column_name, count({n}) AS \"count\", count(DISTINCT {n}) AS \"unique\", "
        f"(SELECT {n} FROM messy WHERE {n} IS NOT NULL GROUP BY {n} ORDER BY count(*) DESC, {n} LIMIT 1) AS top, "
        f"(SELECT count(*) FROM messy WHERE {n} IS NOT NULL GROUP BY {n} ORDER BY count(*) DESC, {n} LIMIT 1) AS freq, "
        f"count(*) FILTER (WHERE {bad}) AS n_invalid, count(DISTINCT {n}) FILTER (WHERE {bad}) AS n_distinct_bad FROM messy"
    )


@query("prf_2", over_messy(" UNION ALL ".join(map(_text_profile_sql, _PROFILED))))
def prf_2(spark, folder):
    found = profile.text_profile(messy(spark, folder).select(*_PROFILED), MESSY_SCHEMA)
    return found.withColumnRenamed("column", "column_name")


_TYPED = f"(SELECT CAST({integer_sql('id')} AS DOUBLE) AS id, {float_sql('revenue')} AS revenue, CAST({integer_sql('budget')} AS DOUBLE) AS budget FROM messy) t"


@query(
    "prf_3",
    over_messy(
        f", typed AS (SELECT * FROM {_TYPED}) "
        + " UNION ALL ".join(f"SELECT 'numeric' AS part, a.*, {unique_sql(n, 'typed')} FROM ({stats_sql(n, 'typed', n)}) a" for n in ("id", "revenue", "budget"))
        + "".join(f" UNION ALL BY NAME SELECT 'text' AS part, a.* FROM ({_text_profile_sql(n)}) a" for n in _PROFILED)
    ),
)
def prf_3(spark, folder):
    """The profile of all columns, both parts as tagged rows."""
    parts = profile.all_columns_profile(messy(spark, folder).select(*_PROFILED), MESSY_SCHEMA)
    parts["numeric"] = rounded(parts["numeric"])
    return tagged(parts).withColumnRenamed("column", "column_name")


# The column types of the declared semantic types, in table order.
_TABLE_DTYPES = {
    "id": ("bigint", "integer"), "title": ("string", "string"), "revenue": ("double", "float"), "budget": ("bigint", "integer"),
    "flag": ("boolean", "boolean"), "day": ("date", "ymd_datetime"), "status": ("string", "order_status"),
    "items": ("array<map<string,string>>", "list_of_dict"), "info": ("map<string,string>", "dict"),
    "homepage": ("string", "string"), "note": ("string", "string"), "blank": ("string", "string"),
}


def _columns_table_sql(names, table="messy", part="") -> str:
    return " UNION ALL BY NAME ".join(
        f"SELECT {part}CAST({i} AS INTEGER) AS position, '{n}' AS column_name, '{_TABLE_DTYPES[n][0]}' AS dtype, '{_TABLE_DTYPES[n][1]}' AS semantic_type, "
        f"count(DISTINCT {n}) AS n_unique, {_null_percent_sql(n).replace(f' AS {n}', ' AS null_percent')} FROM {table}"
        for i, n in enumerate(names)
    )


@query("prf_4", over_messy(_columns_table_sql(_TABLE_DTYPES)))
def prf_4(spark, folder):
    found = profile.columns_table(messy(spark, folder).select(*_TABLE_DTYPES), MESSY_SCHEMA)
    return found.withColumnRenamed("column", "column_name")


def _cell_sql(n: str) -> str:
    """Display text of a text cell: digits to the right, other texts to the left, cut to 8 characters."""
    text = f"translate(coalesce({n}, ''), chr(10) || chr(9), '  ')"
    cut = f"CASE WHEN length({text}) > 8 THEN left({text}, 7) || '…' ELSE {text} END"
    return f"CASE WHEN regexp_full_match({n}, '[0-9]+') THEN lpad({n}, 10, ' ') ELSE rpad({cut}, 10, ' ') END AS {n}"


_SHOWN = ("id", "title", "homepage", "note", "blank")


def _preview_sql(part: str, table: str) -> str:
    return (
        f"SELECT '{part}' AS part, row_id, {', '.join(map(_cell_sql, _SHOWN))} FROM "
        f"(SELECT *, row_number() OVER (ORDER BY row_id) AS a, row_number() OVER (ORDER BY row_id DESC) AS b FROM {table}) WHERE a <= 3 OR b <= 3"
    )


@query(
    "prf_5",
    over_messy(
        ", firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY status, title ORDER BY row_id) AS rn FROM messy) WHERE rn = 1), "
        "pairs AS (SELECT status, title, count(*) AS n, min(row_id) AS row_id FROM messy WHERE status IS NOT NULL GROUP BY status, title HAVING count(*) > 1) "
        + _preview_sql("preview", "messy") + " UNION ALL BY NAME " + _preview_sql("preview_after", "firsts")
        + " UNION ALL BY NAME SELECT 'shape' AS part, count(*) AS rows, CAST(12 AS BIGINT) AS columns FROM messy"
        + " UNION ALL BY NAME SELECT 'duplicates' AS part, status, arg_min(title, row_id) AS title, min(row_id) AS row_id, CAST(sum(n) AS BIGINT) AS \"count\" FROM pairs GROUP BY status"
        + " UNION ALL BY NAME " + _columns_table_sql(_TABLE_DTYPES, "firsts", "'columns_before' AS part, ")
        + " UNION ALL BY NAME " + _columns_table_sql([n for n in _TABLE_DTYPES if n not in ("homepage", "note", "blank")], "firsts", "'columns_after' AS part, ")
    ),
)
def prf_5(spark, folder):
    """All parts of the table profile as tagged rows; of the previews the cells SQL can show alike."""
    df = messy(spark, folder).select("row_id", *_TABLE_DTYPES)
    parts = profile.table_profile(df, MESSY_SCHEMA, "row_id", keys=("status", "title"), percent=60)
    for name in ("preview", "preview_after"):
        parts[name] = parts[name].select("row_id", *_SHOWN)
    return tagged(parts).withColumnRenamed("column", "column_name")


@query(
    "prf_6",
    "SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), greatest(10, length(CAST(o_custkey AS VARCHAR)))::INT, ' ') AS o_custkey, '...' AS \"...\", "
    "rpad(CASE WHEN length(o_orderpriority) > 8 THEN left(o_orderpriority, 7) || '…' ELSE o_orderpriority END, 10, ' ') AS o_orderpriority "
    "FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS a, row_number() OVER (ORDER BY o_orderkey DESC) AS b FROM orders) WHERE a <= 1 OR b <= 1",
)
def prf_6(spark, folder):
    return grid(read_table(spark, folder, "orders"), 1, "o_orderkey")


# -- scaling -----------------------------------------------------------------------------
_FIT = "(SELECT avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi FROM events) f"


def _scored(spark, folder):
    return spread(read_table(spark, folder, "events").select("event_id", "value"), "event_id")


_REVENUE = f"(SELECT row_id, {float_sql('revenue')} AS x FROM messy) t, (SELECT avg(x) AS m, stddev_pop(x) AS s FROM (SELECT {float_sql('revenue')} AS x FROM messy)) f"


@query("scl_1", over_messy(f"SELECT row_id, round((x - m) / s, 6) AS revenue FROM {_REVENUE}"))
def scl_1(spark, folder):
    return rounded(scaling.autoscale(messy(spark, folder).select("row_id", "revenue"), MESSY_SCHEMA, ["revenue"]), 6)


@query(
    "scl_2",
    over_messy(
        f", typed AS (SELECT row_id, {integer_sql('id')} AS id, {float_sql('revenue')} AS revenue, {integer_sql('budget')} AS budget FROM messy) "
        "SELECT row_id, round((id - avg(id) OVER ()) / stddev_pop(id) OVER (), 6) AS id, round((revenue - avg(revenue) OVER ()) / stddev_pop(revenue) OVER (), 6) AS revenue, "
        "round((budget - avg(budget) OVER ()) / stddev_pop(budget) OVER (), 6) AS budget FROM typed"
    ),
)
def scl_2(spark, folder):
    return rounded(scaling.autoscale(messy(spark, folder).select("row_id", "id", "revenue", "budget"), MESSY_SCHEMA), 6)


@query("scl_3", "SELECT l_orderkey, l_partkey, l_linenumber, " + ", ".join(f"round(({n} - avg({n}) OVER ()) / stddev_pop({n}) OVER (), 6) AS {n}" for n in LINE_NUMBERS) + " FROM lineitem")
def scl_3(spark, folder):
    lines = _lines(spark, folder, "l_orderkey", "l_partkey", "l_linenumber", *LINE_NUMBERS)
    return rounded(scaling.standard_scale(lines, LINE_NUMBERS), 6)


@query("scl_4", f"SELECT event_id, round(least(greatest((value - m) / s, -1.5), 1.5), 6) AS value FROM events, {_FIT}")
def scl_4(spark, folder):
    return rounded(scaling.clamp_columns(scaling.standard_scale(_scored(spark, folder), ["value"]), ["value"], 1.5), 6)


@query("scl_5", f"SELECT event_id, round((value - m) / s, 6) AS value FROM events, {_FIT} WHERE abs((value - m) / s) <= 3")
def scl_5(spark, folder):
    return rounded(scaling.drop_outliers(scaling.standard_scale(_scored(spark, folder), ["value"]), ["value"]), 6)


@query("scl_6", f"SELECT event_id, round((value - lo) / (hi - lo), 6) AS value FROM events, {_FIT}")
def scl_6(spark, folder):
    return rounded(scaling.minmax_scale(_scored(spark, folder), ["value"]), 6)


_VARIANTS = (
    f"z AS (SELECT value AS original, (value - m) / s AS z FROM events, {_FIT}), "
    "parts AS (SELECT original, least(greatest(z, -3), 3) AS clamped, CASE WHEN abs(z) <= 3 THEN z END AS dropped FROM z), "
    "variants AS (SELECT original, clamped, (clamped - min(clamped) OVER ()) / (max(clamped) OVER () - min(clamped) OVER ()) AS clamped_minmax, dropped, "
    "(dropped - min(dropped) OVER ()) / (max(dropped) OVER () - min(dropped) OVER ()) AS dropped_minmax FROM parts) "
)


@query("scl_7", f"WITH {_VARIANTS} " + " UNION ALL ".join(stats_sql(v, "variants", v, "variant") for v in scaling.VARIANTS))
def scl_7(spark, folder):
    return rounded(scaling.compare_scalers(_scored(spark, folder), "value", ["value"]))


def _hist_sql(x: str, table: str, stage: str) -> str:
    return (
        f"SELECT '{stage}' AS stage, b.range AS i, count(t.x) AS n FROM range(50) b LEFT JOIN "
        f"(SELECT least(floor((x - lo) / ((hi - lo) / 50)), 49) AS bin, x FROM (SELECT {x} AS x FROM {table}) d, (SELECT min({x}) AS lo, max({x}) AS hi FROM {table}) r) t ON t.bin = b.range GROUP BY b.range"
    )


@query("scl_8", f"WITH scaled AS (SELECT value, (value - m) / s AS z FROM events, {_FIT}) {_hist_sql('value', 'scaled', 'before')} UNION ALL {_hist_sql('z', 'scaled', 'after')}")
def scl_8(spark, folder):
    """Histograms of a column before and after scaling."""
    events = _scored(spark, folder)
    stages = [("before", events), ("after", scaling.standard_scale(events, ["value"]))]
    parts = [histogram(df, "value").select(F.lit(s).alias("stage"), c("bin").alias("i"), "n") for s, df in stages]
    return parts[0].unionByName(parts[1])
