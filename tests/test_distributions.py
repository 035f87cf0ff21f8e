import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gritsieve.operators import analyze, clusters, density, histogram, kmeans1d, mixture, outliers
from gritsieve.operators.dbscan import dbscan_labels
from gritsieve.sources.synthetic import add_noise, mixture_sample, normal_sample


def frame(spark, x):
    return spark.createDataFrame(pd.DataFrame({"x": np.asarray(x, dtype=float)}))


@pytest.fixture(scope="module")
def sample(spark):
    df = mixture_sample(spark).cache()
    yield df
    df.unpersist()


def test_histogram(spark, sample):
    x = sample.toPandas()["x"].to_numpy()
    found = histogram.histogram(sample, "x").orderBy("bin").toPandas()
    counts, edges = np.histogram(x, 50)
    assert found["n"].tolist() == counts.tolist() and np.allclose(found["left_edge"], edges[:-1])
    assert np.isclose((found["density"] * np.diff(edges)).sum(), 1)
    constant = histogram.histogram(frame(spark, [2, 2, 2]), "x", 10).where("n > 0").first()
    assert constant["n"] == 3 and constant["left_edge"] == 2.0
    with pytest.raises(ValueError):
        histogram.histogram(frame(spark, []).where("x > 0"), "x")


@pytest.mark.parametrize(
    "heights, expected",
    [([0, 1, 0], [1]), ([1, 0, 1], []), ([0, 2, 2, 2, 0], [2]), ([0, 2, 2, 0], [1]), ([0, 2, 2, 3, 0], [3]), ([3, 3, 1, 2, 1, 1, 4, 4], [3])],
)
def test_peaks(spark, heights, expected):
    curve = spark.createDataFrame(list(enumerate(map(float, heights))), "i bigint, h double")
    assert sorted(r["i"] for r in histogram.peaks(curve, "i", "h").collect()) == expected


def test_pairwise_bins(spark):
    rng = np.random.default_rng(0)
    p = pd.DataFrame({"a": rng.normal(size=300), "b": rng.random(300)})
    found = histogram.pairwise_bins(spark.createDataFrame(p), ["a", "b"], 5).toPandas()
    pair = found[found.x_col != found.y_col]
    grid = np.zeros((5, 5))
    grid[pair.x_bin, pair.y_bin] = pair.n
    assert (grid == np.histogram2d(p.a, p.b, 5)[0]).all()


@pytest.mark.parametrize("bandwidth", [0.05, 0.5, 3.0])
def test_kernel_density(sample, bandwidth):
    x = sample.toPandas()["x"].to_numpy()
    found = density.kernel_density(sample, "x", bandwidth).orderBy("i").toPandas()
    grid = np.linspace(x.min(), x.max(), 1000)
    z = (grid[:, None] - x[None, :]) / bandwidth
    direct = np.exp(-0.5 * z**2).sum(1) / (len(x) * bandwidth * np.sqrt(2 * np.pi))
    assert np.allclose(found["x"], grid) and np.allclose(found["density"], direct, rtol=1e-9, atol=1e-15)


def test_modes(sample):
    modes = sorted(r["x"] for r in density.density_modes(sample, "x").collect())
    assert len(modes) == 3 and np.allclose(modes, [-5, 0, 5], atol=0.4)


def brute_dbscan(x, eps, k):
    x = np.sort(x)
    core = np.array([(np.abs(x - v) <= eps).sum() >= k for v in x])
    labels, current, last = np.full(len(x), -1), -1, None
    for i in np.where(core)[0]:
        if last is None or x[i] - last > eps:
            current += 1
        labels[i], last = current, x[i]
    for i in np.where(~core)[0]:
        gaps = np.abs(x[core] - x[i])
        if len(gaps) and gaps.min() <= eps:
            labels[i] = labels[core][gaps.argmin()]
    return x, labels


@pytest.mark.parametrize("seed, eps, k", [(0, 0.5, 5), (1, 0.3, 4), (2, 1.0, 1), (3, 0.7, 7)])
def test_dbscan_matches_brute_force(spark, seed, eps, k):
    rng = np.random.default_rng(seed)
    x = np.concatenate(
        [rng.uniform(-40, 40, 150), np.round(rng.uniform(-20, 20, 100), 1), np.full(120, 3.25), rng.uniform(7, 7.1, 60), [-0.0, 0.0]]
    )
    values, labels = brute_dbscan(x, eps, k)
    found = dbscan_labels(frame(spark, x), "x", eps, k).orderBy("x").toPandas()
    expected = pd.DataFrame({"x": values, "e": labels}).drop_duplicates()
    merged = found.drop_duplicates().merge(expected, on="x")
    assert len(found) == len(x) and (merged["label"] == merged["e"]).all()


def test_dbscan_missing_values_and_noise(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (50.0,)], "x double")
    assert sorted(str(r["label"]) for r in dbscan_labels(df, "x").collect()) == ["-1", "-1", "None", "None"]


def test_mixture_recovers_the_sample(sample):
    found = mixture.em_parameters(sample, "x").orderBy("component").toPandas()
    assert np.allclose(found["mean"], [-5, 0, 5], atol=0.2)
    assert np.allclose(found["weight"], [1 / 3, 1 / 2, 1 / 6], atol=0.03)
    assert np.allclose(found["sd"], [1, 1.5, 0.5], atol=0.15) and np.isclose(found["weight"].sum(), 1)


def test_mixture_curves_and_restarts(sample):
    one, best = mixture.fit_mixture(sample, "x"), mixture.fit_mixture(sample, "x", restarts=4)
    assert best.log_likelihood >= one.log_likelihood - 1e-6
    curves = mixture.component_curves(sample, "x", one).toPandas()
    whole = curves[curves.component == -1].sort_values("i")
    parts = curves[curves.component >= 0].groupby("i")[["density", "responsibility"]].sum()
    assert np.allclose(parts["density"], whole["density"]) and np.allclose(parts["responsibility"], 1)
    assert np.isclose(np.trapezoid(whole["density"], whole["x"]), 1, atol=0.01)


def test_mixture_labels(sample):
    rows = mixture.mixture_labels(sample, "x").toPandas().groupby("label")["x"].agg(["mean", "size"])
    assert np.allclose(rows["mean"], [-5, 0, 5], atol=0.2) and rows["size"].sum() == 3000


def test_variational_mixture(sample):
    curve = mixture.bayesian_curve(sample, "x").orderBy("i").toPandas()
    assert np.isclose(np.trapezoid(curve["density"], curve["x"]), 1, atol=0.02)
    posterior = mixture.fit_variational(sample, "x")
    assert np.allclose(np.sort(posterior.means), [-5, 0, 5], atol=0.3)


def test_digamma():
    known = {1.0: -0.5772156649015329, 0.5: -1.9635100260214235, 10.0: 2.251752589066721}
    assert np.allclose(mixture._digamma(np.array(list(known))), list(known.values()), atol=1e-7)


def test_centers(sample):
    x = sample.toPandas()["x"]
    centers = [r["center"] for r in mixture.kmeans_centers(sample, "x").orderBy("cluster").collect()]
    assert centers == sorted(centers) and x.min() < centers[0] and centers[-1] < x.max()
    assert np.allclose(centers, [-5, 0, 5], atol=0.5)
    shifted = [r["center"] for r in clusters.mean_shift_centers(sample, "x").collect()]
    assert np.allclose(shifted, [-5, 0, 5], atol=0.5)
    units = [r["weight"] for r in clusters.self_organising_map(sample, "x").orderBy("unit").collect()]
    assert len(units) == 10 and units == sorted(units) and x.min() <= units[0] and units[-1] <= x.max()


def brute_ward(x, k):
    groups = [[v] for v in sorted(x)]
    cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * (np.mean(a) - np.mean(b)) ** 2
    while len(groups) > k:
        pairs = [(cost(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = min(pairs)
        groups[i] += groups.pop(j)
    return sorted(sorted(g) for g in groups)


def test_ward_matches_all_pairs(spark):
    x = np.random.default_rng(5).normal(size=40).round(3)
    found = clusters.ward_labels(frame(spark, x), "x", 4).toPandas().groupby("label")["x"].apply(sorted).tolist()
    assert sorted(found) == brute_ward(x, 4)


def test_isolation_forest(spark, sample):
    labels = outliers.isolation_labels(sample, "x").toPandas()
    share = (labels["label"] == -1).mean()
    assert 0.05 < share <= 0.1001
    scores = outliers.isolation_scores(frame(spark, [*np.random.default_rng(0).normal(size=500), 40.0]), "x").toPandas()
    assert scores.sort_values("score")["x"].iloc[0] == 40.0
    empty = outliers.isolation_scores(spark.createDataFrame([(None,)], "x double"), "x")
    assert empty.first()["score"] is None


def test_group_histogram(spark, sample):
    df = sample.withColumn("g", F.when(F.col("x") > 2, "high").otherwise("low"))
    found = histogram.group_histogram(df, "x", "g", 10).toPandas()
    x = df.toPandas()
    for g, part in found.groupby("group"):
        assert part.sort_values("bin")["n"].tolist() == np.histogram(x.x[x.g == g], 10)[0].tolist()


def test_samples(spark):
    assert normal_sample(spark, 5, 2, 4000).agg(F.avg("x")).first()[0] == pytest.approx(5, abs=0.2)
    noisy = add_noise(spark.range(4000).select(F.lit(1.0).alias("x")), "x", scale=0.5)
    assert noisy.agg(F.stddev("x")).first()[0] == pytest.approx(0.5, abs=0.05)


def test_registry(spark, sample):
    assert len(analyze.BUILT_IN) == 15
    found = analyze.summary(sample, "x", ["histogram_peaks", "kmeans"])
    assert {r["method"] for r in found.collect()} == {"histogram_peaks", "kmeans"}
    analyze.register_analysis("mean", lambda df, col: df.agg(F.avg(col).alias("density")).withColumn("x", F.lit(0.0)))
    assert "mean" in analyze.analyze(sample, "x", ["mean"])
    assert analyze.analyze_one(sample, "x", 2).columns == ["bin", "left_edge", "density"]
    with pytest.raises(ValueError):
        analyze.analyze(sample, "x", ["nope"])


def brute_mean_shift(x, quantile=0.2):
    n = len(x)
    bandwidth = np.sort(np.abs(x[:, None] - x[None, :]), 1)[:, max(int(n * quantile), 1) - 1].mean()
    within = lambda s: x[(x >= s - bandwidth) & (x <= s + bandwidth)]
    seeds = np.unique(np.round(x / bandwidth)) * bandwidth
    for _ in range(300):
        moved = np.array([within(s).mean() if len(within(s)) else s for s in seeds])
        done = np.abs(moved - seeds).max() < 1e-3 * bandwidth
        seeds = np.unique(moved)
        if done:
            break
    kept = []
    for strength, center in sorted(((len(within(s)), s) for s in seeds), reverse=True):
        if strength > 0 and all(abs(center - other) > bandwidth for other, _ in kept):
            kept.append((center, strength))
    return sorted(kept), bandwidth


def ward_borders(x, k):
    top, n = np.unique(x, return_counts=True)
    top, n, mean = list(top), [float(v) for v in n], list(top)
    while len(n) > k:
        a, b = np.array(n[:-1]), np.array(n[1:])
        i = int(np.argmin(a * b / (a + b) * np.diff(mean) ** 2))
        total = n[i] + n[i + 1]
        mean[i] = (n[i] * mean[i] + n[i + 1] * mean[i + 1]) / total
        n[i], top[i] = total, top[i + 1]
        del n[i + 1], mean[i + 1], top[i + 1]
    return top[:-1]


@pytest.mark.parametrize("kind", ["mixed", "ties", "tails"])
def test_mean_shift_and_ward_match_brute_force(spark, kind):
    rng = np.random.default_rng(8)
    x = {
        "mixed": np.concatenate([rng.normal(-5, 1, 2000), rng.normal(0, 1.5, 2200), rng.normal(5, 0.5, 800)]),
        "ties": rng.integers(0, 12, 5000).astype(float),
        "tails": np.append(rng.normal(size=998), [1e6, -1e5]),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(7)
    found = clusters.mean_shift_centers(df, "x").orderBy("center").collect()
    kept, bandwidth = brute_mean_shift(x)
    assert np.allclose([r["center"] for r in found], [c for c, _ in kept]) and [r["n_within"] for r in found] == [n for _, n in kept]
    assert np.isclose(found[0]["bandwidth"], bandwidth)
    for k in (1, 3, 6):
        labels = clusters.ward_labels(df, "x", k).toPandas()
        assert (labels["label"] == np.searchsorted(ward_borders(x, k), labels["x"], "left")).all()


def ward_steps(x):
    """Merges as (lo, left hi, right lo, hi): (cost, rows), always the cheapest pair of neighbours."""
    lo, n = np.unique(x, return_counts=True)
    lo, hi, n, mean, out = list(lo), list(lo), [float(v) for v in n], list(lo), {}
    while len(n) > 1:
        a, b = np.array(n[:-1]), np.array(n[1:])
        costs = a * b / (a + b) * np.diff(mean) ** 2
        i = int(np.argmin(costs))
        out[lo[i], hi[i], lo[i + 1], hi[i + 1]] = float(costs[i]), n[i] + n[i + 1]
        mean[i] = (n[i] * mean[i] + n[i + 1] * mean[i + 1]) / (n[i] + n[i + 1])
        n[i], hi[i] = n[i] + n[i + 1], hi[i + 1]
        del lo[i + 1], hi[i + 1], n[i + 1], mean[i + 1]
    return out


def test_ward_tree_holds_every_merge(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(0, 1, 150), rng.normal(9, 2, 49), [1e4], np.repeat(3.5, 70)])
    df = frame(spark, [*x, None, float("nan")]).repartition(7)
    found = clusters.ward_tree(df, "x").orderBy("step").collect()
    want = ward_steps(x)
    assert [r["step"] for r in found] == list(range(len(np.unique(x)) - 1))
    assert [r["cost"] for r in found] == sorted(r["cost"] for r in found)
    for r in found:
        cost, size = want.pop((r["left_lo"], r["left_hi"], r["right_lo"], r["right_hi"]))
        assert r["size"] == size and np.isclose(r["cost"], cost)
        for part in ("left", "right"):
            lo, hi, step = r[f"{part}_lo"], r[f"{part}_hi"], r[f"{part}_step"]
            assert (step is None) == (lo == hi)
            if step is not None:
                assert step < r["step"] and (found[step]["left_lo"], found[step]["right_hi"]) == (lo, hi)
    assert not want
    for k in range(2, len(found) + 2):
        assert sorted(r["left_hi"] for r in found[-(k - 1) :]) == ward_borders(x, k)
    assert clusters.ward_tree(frame(spark, [2.0, 2.0, None]), "x").count() == 0
    assert clusters.ward_tree(df.where("x IS NULL"), "x").count() == 0


def test_each_tree_draws_its_own_rows(spark):
    df = spark.range(20_000).select(F.col("id").cast("double").alias("x")).repartition(5)
    samples = outliers._tree_samples(df, 50, 256, 1)
    assert len(samples) == 50 and all(len(s) == 256 == len(set(s)) for s in samples)
    assert len({v for s in samples for v in s}) > 0.4 * 50 * 256
    assert abs(np.mean(np.concatenate(samples)) - 10_000) < 300
    assert [len(s) for s in outliers._tree_samples(df.limit(30), 7, 256, 1)] == [30] * 7


def test_dbscan_with_hot_values_and_many_nulls(spark):
    x = [None] * 300 + [float("inf")] * 200 + [4.0] * 300 + [4.4, 9.0, 9.1, 20.0]
    rows = dbscan_labels(frame(spark, x).repartition(5), "x", eps=0.5, min_samples=3).collect()
    assert len(rows) == len(x)
    got = {r["x"]: r["label"] for r in rows}
    assert got[4.0] == got[4.4] == 0 and got[9.0] == got[9.1] == got[20.0] == -1 and got[None] is None


def test_dbscan_takes_values_of_any_size(spark):
    x = [1.0, 2.0, 1e300, 1e300, 1e300, float("inf"), float("inf"), -1e18, -1e18, 1.2, 1.4]
    rows = dbscan_labels(frame(spark, x), "x", eps=0.5, min_samples=2).collect()
    got = sorted((r["x"], r["label"]) for r in rows)
    assert got == [(-1e18, 0), (-1e18, 0), (1.0, 1), (1.2, 1), (1.4, 1), (2.0, -1), *[(1e300, 2)] * 3, *[(float("inf"), -1)] * 2]


def test_more_restarts_never_score_lower(spark):
    rng = np.random.default_rng(6)
    df = frame(spark, np.concatenate([rng.normal(-4, 1, 300), rng.normal(0, 0.4, 150), rng.exponential(6, 250)]))
    scores = [mixture.fit_mixture(df, "x", k=4, restarts=r).log_likelihood for r in range(1, 7)]
    assert all(b >= a - 1e-6 for a, b in zip(scores, scores[1:]))


def plain_em(x, centers, rows_tolerance=mixture.TOLERANCE, max_iter=100):
    own = np.searchsorted((np.array(centers[1:]) + np.array(centers[:-1])) / 2, x)
    r = np.eye(len(centers))[own]
    last = None
    for _ in range(max_iter):
        n = np.maximum(r.sum(0), 1e-15)
        mean = r.T @ x / n
        var = ((x[:, None] - mean) ** 2 * r).sum(0) / n + mixture.VARIANCE_FLOOR
        logs = np.log(n / len(x)) - 0.5 * np.log(2 * np.pi * var) - (x[:, None] - mean) ** 2 / (2 * var)
        total = np.logaddexp.reduce(logs, 1)
        r = np.exp(logs - total[:, None])
        if last is not None and abs(total.sum() - last) < rows_tolerance * len(x):
            break
        last = total.sum()
    order = np.argsort(mean)
    return (n / n.sum())[order], mean[order], np.sqrt(var)[order], total.sum()


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_mixture_equals_plain_em_from_the_same_starts(sample, k):
    x = sample.toPandas()["x"].to_numpy()
    starts = mixture._start_centers(mixture.distinct_points(sample), k, 3)
    assert all(len(s) == k and s == sorted(s) for s in starts) and (k == 1 or len({tuple(s) for s in starts}) == 3)
    weights, means, sds, score = max((plain_em(x, s) for s in starts), key=lambda f: f[3])
    found = mixture.fit_mixture(sample, "x", k, restarts=3)
    assert np.allclose(found.means, means) and np.allclose(found.weights, weights) and np.allclose(found.sds, sds)
    assert found.log_likelihood == pytest.approx(score)


def test_starts_do_not_depend_on_the_split(spark, sample):
    one, many = (mixture._start_centers(mixture.distinct_points(sample.repartition(n)), 3, 2) for n in (1, 9))
    assert np.allclose(one, many)


def variational_twin(x, center, iterations):
    """Responsibilities, posterior and bound written out over rows."""
    k, o, prior = len(center), x.mean(), max(x.var(ddof=1), mixture.VARIANCE_FLOOR)
    lgamma = np.vectorize(__import__("math").lgamma)
    r = np.eye(k)[np.searchsorted((np.array(center[1:]) + np.array(center[:-1])) / 2, x)]
    bounds = []
    for step in range(iterations + 1):
        n = r.sum(0) + 1e-15
        mean = r.T @ x / n
        scatter = ((x[:, None] - mean) ** 2 * r).sum(0) / n + mixture.VARIANCE_FLOOR
        dof, prec = 1 + n, 1 + n
        m = (o + n * mean) / prec
        v = (prior + n * (scatter + (mean - o) ** 2 / prec)) / dof
        a, b = 1 + n, 1 / k + np.array([n[i + 1 :].sum() for i in range(k)])
        if step:
            some = r[r > 0]
            norm = lgamma(a) + lgamma(b) - lgamma(a + b) + lgamma(dof / 2) + dof / 2 * np.log(2) - dof / 2 * np.log(v * dof) - 0.5 * np.log(prec)
            bounds.append(-(some * np.log(some)).sum() + norm.sum())
        dg = mixture._digamma
        log_w = dg(a) - dg(a + b) + np.array([(dg(b) - dg(a + b))[:i].sum() for i in range(k)])
        logs = log_w - 0.5 * np.log(2 * np.pi * v * dof) + 0.5 * (np.log(2) + dg(dof / 2) - 1 / prec) - (x[:, None] - m) ** 2 / (2 * v)
        r = np.exp(logs - np.logaddexp.reduce(logs, 1)[:, None])
    return m, v, bounds


@pytest.mark.parametrize("k", [1, 3, 4])
def test_evidence_bound_rises_and_equals_its_definition(sample, k):
    found = mixture.fit_variational(sample, "x", k, max_iter=25)
    bounds = np.array(found.bounds)
    assert (np.diff(bounds) > -1e-3).all()
    x = sample.toPandas()["x"].to_numpy()
    m, v, twin = variational_twin(x, mixture._start_centers(mixture.distinct_points(sample), k, 1)[0], len(bounds))
    assert np.allclose(bounds, twin, rtol=1e-8) and np.allclose(found.means, m) and np.allclose(found.variances, v)
    table = mixture.bayesian_parameters(sample, "x", k, max_iter=25).collect()
    assert {r["bound"] for r in table} == {bounds[-1]} and sum(r["weight"] for r in table) == pytest.approx(1)


def least_cost(x, k):
    """The least sum of squares of at most k clusters of the sorted values, by trying every last cut."""
    v, w = np.unique(x, return_counts=True)
    o = v.mean()
    sums = [np.r_[0, np.cumsum(w * (v - o) ** p)] for p in (0, 1, 2)]
    best = np.r_[0.0, np.full(len(v), np.inf)]
    for _ in range(k):
        nxt = best.copy()
        for j in range(1, len(v) + 1):
            i = np.arange(j)
            n, s, q = (t[j] - t[i] for t in sums)
            nxt[j] = min(best[j], (best[i] + q - s * s / n).min())
        best = nxt
    return best[-1]


@pytest.mark.parametrize("kind", ["normal", "parts", "tails", "few", "even"])
def test_exact_kmeans_equals_brute_force(spark, kind, monkeypatch):
    rng = np.random.default_rng(12)
    x = {
        "normal": rng.normal(size=700),
        "parts": np.concatenate([rng.normal(-5, 1, 300), rng.normal(5, 0.3, 300), np.full(200, 1.5)]),
        "tails": np.append(rng.normal(size=400), [1e6, -1e5, 1e6 + 1]),
        "few": rng.integers(0, 9, 2000).astype(float),
        "even": np.arange(500.0),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(5)
    scale = ((x - x.mean()) ** 2).sum()
    monkeypatch.setattr(kmeans1d, "CELLS", 64)  # several rounds
    for k in (1, 2, 4, 6):
        found = kmeans1d.exact_kmeans(df, "x", k).orderBy("cluster").collect()
        assert sum(r["cost"] for r in found) == pytest.approx(least_cost(x, k), abs=1e-8 * scale)
        own = np.searchsorted([r["upto"] for r in found], x)
        for i, r in enumerate(found):
            assert r["size"] == (own == i).sum() and r["center"] == pytest.approx(x[own == i].mean())
    with_missing = spark.createDataFrame([(2.0,), (None,), (float("nan"),), (2.0,)], "x double")
    assert [tuple(r) for r in kmeans1d.exact_kmeans(with_missing, "x", 3).collect()] == [(0, 2.0, 2, 2.0, 0.0)]


def test_kmeans_of_mllib_is_still_there(sample):
    found = mixture.kmeans_centers(sample, "x", exact=False).collect()
    assert len(found) == 3 and found[0]["center"] < found[2]["center"]
