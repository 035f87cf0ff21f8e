"""Queries over the distribution analyses of one numeric column."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritsieve.catalog.base import query
from gritsieve.catalog.statistics import rounded
from gritsieve.operators import analyze, clusters, density, histogram, mixture, outliers
from gritsieve.operators.dbscan import dbscan_labels
from gritsieve.operators.kmeans1d import exact_kmeans
from gritsieve.sources.files import read_table

c = F.col


def _events(spark, folder):
    return read_table(spark, folder, "events").select("event_id", "event_type", "value")


def _bins_sql(x: str, table: str, bins: int) -> str:
    return (
        f"r AS (SELECT min({x}) AS lo, (max({x}) - min({x})) / {bins} AS w, count({x}) AS total FROM {table}), "
        f"counts AS (SELECT least(floor(({x} - lo) / w), {bins - 1}) AS bin, count(*) AS n FROM {table}, r WHERE {x} IS NOT NULL GROUP BY 1), "
        f"hist AS (SELECT b.range AS bin, r.lo + b.range * r.w AS left_edge, coalesce(counts.n, 0) AS n, coalesce(counts.n, 0) / (r.total * r.w) AS density "
        f"FROM range({bins}) b CROSS JOIN r LEFT JOIN counts ON counts.bin = b.range)"
    )


def _grid_sql(x: str, table: str) -> str:
    return (
        f"f AS (SELECT min({x}) AS lo, max({x}) AS hi, avg({x}) AS m, stddev_samp({x}) AS s, count({x}) AS n FROM {table}), "
        f"grid AS (SELECT g.range AS i, CASE WHEN g.range = 999 THEN hi ELSE lo + g.range * ((hi - lo) / 999) END AS x FROM range(1000) g, f)"
    )


def _kde_sql(x: str, table: str, h: str) -> str:
    return (
        f"{_grid_sql(x, table)}, values_ AS (SELECT {x} AS v, count(*) AS k FROM {table} WHERE {x} IS NOT NULL GROUP BY {x}), "
        f"curve AS (SELECT grid.i, grid.x, sum(k * exp(-0.5 * ((grid.x - v) / {h}) ** 2)) / (any_value(f.n) * any_value({h}) * sqrt(2 * pi())) AS density "
        f"FROM grid, values_, f GROUP BY grid.i, grid.x)"
    )


def _peaks_sql(curve: str, at: str, height: str) -> str:
    return (
        f"marks AS (SELECT *, CASE WHEN {height} = lag({height}) OVER (ORDER BY {at}) THEN 0 ELSE 1 END AS fresh FROM {curve}), "
        f"numbered AS (SELECT *, sum(fresh) OVER (ORDER BY {at}) AS run FROM marks), "
        f"runs AS (SELECT run, min({at}) AS a, max({at}) AS b, any_value({height}) AS h FROM numbered GROUP BY run), "
        f"tops AS (SELECT (a + b) // 2 AS at_, h, lag(h) OVER (ORDER BY run) AS before_, lead(h) OVER (ORDER BY run) AS after_ FROM runs), "
        f"peaks AS (SELECT {curve}.* FROM {curve} JOIN tops ON tops.at_ = {curve}.{at} WHERE h > before_ AND h > after_)"
    )


@query("dst_1", f"WITH {_bins_sql('l_extendedprice', 'lineitem', 50)} SELECT bin, round(left_edge, 6) AS left_edge, n, round(density, 12) AS density FROM hist")
def dst_1(spark, folder):
    found = histogram.histogram(read_table(spark, folder, "lineitem"), "l_extendedprice")
    return found.select("bin", F.round("left_edge", 6).alias("left_edge"), "n", F.round("density", 12).alias("density"))


@query(
    "dst_2",
    f"WITH {_bins_sql('value', 'events', 50)}, {_grid_sql('value', 'events')} "
    "SELECT 'histogram' AS kind, bin AS i, round(left_edge, 6) AS x, round(density, 10) AS density FROM hist UNION ALL "
    "SELECT 'normal', i, round(x, 6), round(exp(-0.5 * ((x - m) / s) ** 2) / (s * sqrt(2 * pi())), 10) FROM grid, f",
)
def dst_2(spark, folder):
    found = histogram.distribution_with_normal(_events(spark, folder), "value")
    return found.select("kind", "i", F.round("x", 6).alias("x"), F.round("density", 10).alias("density"))


_PAIRED = ("l_quantity", "l_extendedprice", "l_discount")


def _pair_sql(a: str, b: str) -> str:
    density = f"round(count(*) / (any_value(n_{a}) * any_value(w_{a})), 10)" if a == b else "CAST(NULL AS DOUBLE)"
    bin_of = lambda n: f"CAST(least(floor(({n} - lo_{n}) / w_{n}), 19) AS BIGINT)"
    return f"SELECT '{a}' AS x_col, '{b}' AS y_col, {bin_of(a)} AS x_bin, {bin_of(b)} AS y_bin, count(*) AS n, {density} AS density FROM lineitem, f GROUP BY 3, 4"


@query(
    "dst_3",
    "WITH f AS (SELECT " + ", ".join(f"min({n}) AS lo_{n}, (max({n}) - min({n})) / 20 AS w_{n}, count({n}) AS n_{n}" for n in _PAIRED) + " FROM lineitem) "
    + " UNION ALL ".join(_pair_sql(a, b) for i, a in enumerate(_PAIRED) for b in _PAIRED[i:]),
)
def dst_3(spark, folder):
    found = histogram.pairwise_bins(read_table(spark, folder, "lineitem"), _PAIRED)
    return rounded(found, 10)


@query("dst_4", f"WITH {_bins_sql('value', 'events', 50)}, {_peaks_sql('hist', 'bin', 'n')} SELECT bin, round(left_edge, 6) AS left_edge, round(density, 10) AS density FROM peaks")
def dst_4(spark, folder):
    found = histogram.histogram_peaks(_events(spark, folder), "value")
    return found.select("bin", F.round("left_edge", 6).alias("left_edge"), F.round("density", 10).alias("density"))


def _curve(found):
    return found.select("i", F.round("x", 6).alias("x"), F.round("density", 10).alias("density"))


@query("dst_5", f"WITH {_kde_sql('value', 'events', '0.5')} SELECT i, round(x, 6) AS x, round(density, 10) AS density FROM curve")
def dst_5(spark, folder):
    return _curve(density.kernel_density(_events(spark, folder), "value"))


_SCOTT = _kde_sql("value", "events", "(f.s * pow(f.n, -0.2))")


@query("dst_6", f"WITH {_SCOTT}, {_peaks_sql('curve', 'i', 'density')} SELECT i, round(x, 6) AS x, round(density, 10) AS density FROM peaks")
def dst_6(spark, folder):
    return _curve(density.density_modes(_events(spark, folder), "value"))


@query("dst_7", f"WITH {_SCOTT} SELECT i, round(x, 6) AS x, round(density, 10) AS density FROM curve")
def dst_7(spark, folder):
    return _curve(density.scott_density(_events(spark, folder), "value"))


@query("dst_8")
def dst_8(spark, folder):
    return mixture.mixture_analysis(_events(spark, folder), "value")


@query("dst_9")
def dst_9(spark, folder):
    return mixture.em_parameters(_events(spark, folder), "value")


@query("dst_10")
def dst_10(spark, folder):
    return mixture.finite_mixture_curve(_events(spark, folder), "value")


@query("dst_11")
def dst_11(spark, folder):
    return mixture.mixture_labels(_events(spark, folder), "value")


@query(
    "dst_12",
    "WITH v AS (SELECT value AS x, count(*) AS w FROM events GROUP BY value), "
    "core AS (SELECT a.x FROM v a JOIN v b ON b.x BETWEEN a.x - 0.6 AND a.x + 0.6 AND abs(b.x - a.x) <= 0.5 GROUP BY a.x HAVING sum(b.w) >= 5), "
    "starts AS (SELECT x, CASE WHEN x - lag(x) OVER (ORDER BY x) <= 0.5 THEN 0 ELSE 1 END AS fresh FROM core), "
    "clusters AS (SELECT x, sum(fresh) OVER (ORDER BY x) - 1 AS cluster FROM starts), "
    "near AS (SELECT v.x, c.cluster, row_number() OVER (PARTITION BY v.x ORDER BY abs(c.x - v.x), c.x) AS rn FROM v JOIN clusters c ON c.x BETWEEN v.x - 0.6 AND v.x + 0.6 AND abs(c.x - v.x) <= 0.5) "
    "SELECT event_id, value, CAST(coalesce(cluster, -1) AS BIGINT) AS label FROM events LEFT JOIN near ON near.x = events.value AND rn = 1",
)
def dst_12(spark, folder):
    return dbscan_labels(_events(spark, folder).select("event_id", "value"), "value")


@query(
    "dst_13",
    # every pair of cuts between the distinct values
    "WITH v AS (SELECT l_quantity AS x, count(*) AS w FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1), "
    "p AS (SELECT row_number() OVER (ORDER BY x) AS i, x, sum(w) OVER o AS n, sum(w * x) OVER o AS s, sum(w * x * x) OVER o AS q FROM v WINDOW o AS (ORDER BY x)), "
    "z AS (SELECT 0 AS i, 0 AS n, 0 AS s, 0 AS q UNION ALL SELECT i, n, s, q FROM p), "
    "parts AS (SELECT a.i AS lo, b.i AS hi, b.n - a.n AS n, (b.s - a.s) / (b.n - a.n) AS m, (b.q - a.q) - (b.s - a.s) * ((b.s - a.s) / (b.n - a.n)) AS cost FROM z a JOIN z b ON a.i < b.i), "
    "best AS (SELECT c.lo AS cut1, c.hi AS cut2 FROM parts c JOIN parts l ON l.lo = 0 AND l.hi = c.lo JOIN parts r ON r.lo = c.hi AND r.hi = (SELECT max(i) FROM p) "
    "ORDER BY round(l.cost + c.cost + r.cost, 6), cut1, cut2 LIMIT 1), "
    "found AS (SELECT parts.* FROM parts, best WHERE (lo, hi) IN ((0, cut1), (cut1, cut2)) OR (lo = cut2 AND hi = (SELECT max(i) FROM p))) "
    "SELECT CAST(row_number() OVER (ORDER BY lo) - 1 AS INTEGER) AS cluster, round(m, 6) AS center, CAST(found.n AS BIGINT) AS size, CAST(p.x AS DOUBLE) AS upto FROM found JOIN p ON p.i = found.hi",
)
def dst_13(spark, folder):
    found = exact_kmeans(read_table(spark, folder, "lineitem"), "l_quantity", 3)
    return found.select("cluster", F.round("center", 6).alias("center"), "size", "upto")


@query("dst_14")
def dst_14(spark, folder):
    return clusters.mean_shift_centers(_events(spark, folder), "value")


@query("dst_15")
def dst_15(spark, folder):
    return clusters.ward_labels(_events(spark, folder), "value")


@query("dst_15_tree")
def dst_15_tree(spark, folder):
    return clusters.ward_tree(_events(spark, folder), "value")


@query("dst_16")
def dst_16(spark, folder):
    return outliers.isolation_labels(_events(spark, folder), "value")


@query("dst_17")
def dst_17(spark, folder):
    return mixture.bayesian_curve(_events(spark, folder), "value")


@query("dst_18")
def dst_18(spark, folder):
    return clusters.self_organising_map(_events(spark, folder), "value")


@query("dst_19")
def dst_19(spark, folder):
    return analyze.summary(_events(spark, folder), "value", analyze.BUILT_IN)


@query(
    "dst_20",
    "WITH r AS (SELECT event_type AS g, min(value) AS lo, (max(value) - min(value)) / 50 AS w, count(value) AS total FROM events GROUP BY 1), "
    "counts AS (SELECT event_type AS g, least(floor((value - lo) / w), 49) AS bin, count(*) AS n FROM events JOIN r ON r.g = events.event_type GROUP BY 1, 2) "
    'SELECT r.g AS "group", b.range AS bin, round(lo + b.range * w, 6) AS left_edge, coalesce(n, 0) AS n, round(coalesce(n, 0) / (total * w), 10) AS density '
    "FROM r CROSS JOIN range(50) b LEFT JOIN counts ON counts.g = r.g AND counts.bin = b.range",
)
def dst_20(spark, folder):
    found = histogram.group_histogram(_events(spark, folder), "value", "event_type")
    return found.select("group", "bin", F.round("left_edge", 6).alias("left_edge"), "n", F.round("density", 10).alias("density"))
