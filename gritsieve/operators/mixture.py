"""Gaussian mixtures of one column: likelihood and variational fits, curves and labels."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, replace
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from gritsieve.functions.scalars import drop_nan, normal_pdf
from gritsieve.operators.histogram import GRID, column_values, grid_points, summarise
from gritsieve.operators.kmeans1d import Cells, exact_kmeans
from gritsieve.operators.points import distinct_points

COMPONENTS = 3
TOLERANCE = 1e-3
VARIANCE_FLOOR = 1e-6


@dataclass(frozen=True)
class Mixture:
    """Components in order of their means."""

    weights: tuple[float, ...]
    means: tuple[float, ...]
    sds: tuple[float, ...]
    log_likelihood: float

    def parts(self, x: Column) -> list[Column]:
        return [normal_pdf(x, m, s, w) for w, m, s in zip(self.weights, self.means, self.sds)]

    def density(self, x: Column) -> Column:
        return reduce(add, self.parts(x))

    def label(self, x: Column) -> Column:
        """The likeliest component; logarithms keep far values decided."""
        logs = [
            math.log(max(w, 1e-300) / s) - 0.5 * F.pow((x - m) / s, 2)
            for w, m, s in zip(self.weights, self.means, self.sds)
        ]
        best = F.greatest(*logs)
        pick = F.lit(len(logs) - 1)
        for i in reversed(range(len(logs) - 1)):
            pick = F.when(logs[i] == best, i).otherwise(pick)
        return pick


def _ordered(weights, means, sds, log_likelihood: float) -> Mixture:
    rows = sorted(zip(means, weights, sds))
    return Mixture(
        tuple(float(w) for _, w, _ in rows), tuple(float(m) for m, _, _ in rows), tuple(float(s) for _, _, s in rows),
        float(log_likelihood),
    )


# Iterations build their expressions as SQL text: one call each instead of one per operator.

Sums = tuple[np.ndarray, np.ndarray, np.ndarray]


def _normal_log(fixed: float, mean: float, variance: float) -> str:
    """A constant plus the exponent of a normal density of x."""
    gap = f"(x - {float(mean)!r}D)"
    return f"({float(fixed)!r}D - {gap} * {gap} / {float(2 * variance)!r}D)"


def _log_sum(logs: list[str]) -> str:
    top = f"greatest({', '.join(logs)})" if len(logs) > 1 else logs[0]
    return f"{top} + ln({' + '.join(f'exp({part} - {top})' for part in logs)})"


ROUNDS = 3  # of oversampling
OVERSAMPLE = 2  # candidates a round, as a multiple of k


def _uniform(x: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1] for each value, the same wherever and whenever it is asked for."""
    z = (x + 0.0).view(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2**-54


def _drawn(data: DataFrame, found: list[np.ndarray], size: int, salt: int) -> list[np.ndarray]:
    """For each start ``size`` values drawn by weight times squared distance to its candidates, in one pass.

    Of values with weights p, those with the least -ln(u) / p are such a draw without repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0)) for _ in found]
        for batch in batches:
            x, w = (batch.column(c).to_numpy() for c in ("x", "w"))
            for r, centers in enumerate(found):
                if len(centers):
                    near = np.abs(x[:, None] - centers[None, :]).min(1) if len(x) else x
                    p = w * near * near
                else:
                    p = w
                some = p > 0
                keys = np.r_[best[r][0], -np.log(_uniform(x[some], salt + 1000 * r)) / p[some]]
                values = np.r_[best[r][1], x[some]]
                order = np.argsort(keys, kind="stable")[:size]
                best[r] = keys[order], values[order]
        n = [len(k) for k, _ in best]
        columns = [np.repeat(np.arange(len(n)), n), np.concatenate([k for k, _ in best]), np.concatenate([v for _, v in best])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["r", "k", "x"])

    place = F.row_number().over(Window.partitionBy("r").orderBy("k", "x"))
    rows = data.select("x", "w").mapInArrow(run, "r long, k double, x double").withColumn("place", place).where(F.col("place") <= size)
    out = [list(c) for c in found]
    for r in rows.collect():
        out[r["r"]].append(r["x"])
    return [np.unique(c) for c in out]


def _start_centers(data: DataFrame, k: int, restarts: int) -> list[list[float]]:
    """Oversampled k-means seeding of each start: some rounds of draws by distance, candidates weighted by what is nearest, k of them best.

    Start r is drawn by hashes of the values and r alone, so a fit with more restarts has all
    starts of one with fewer, and never a worse score.
    """
    found = _drawn(data, [np.zeros(0) for _ in range(restarts)], 1, 1)
    for salt in range(ROUNDS):
        found = _drawn(data, found, OVERSAMPLE * k, 2 + salt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(len(c)) for c in found]
        for batch in batches:
            x, w = (batch.column(c).to_numpy() for c in ("x", "w"))
            for own, centers in zip(sums, found):
                own += np.bincount(np.searchsorted((centers[1:] + centers[:-1]) / 2, x), w, len(centers))
        for r, own in enumerate(sums):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), r)), pa.array(np.arange(len(own))), pa.array(own)], ["r", "i", "w"])

    weights = [np.zeros(len(c)) for c in found]
    for row in data.select("x", "w").mapInArrow(run, "r long, i long, w double").groupBy("r", "i").agg(F.sum("w").alias("w")).collect():
        weights[row["r"]][row["i"]] = row["w"]
    out = []
    for x, w in zip(found, weights):
        x, w = x[w > 0], w[w > 0]
        origin = float(x.mean())
        cells = Cells(x, x, w, w * (x - origin), w * (x - origin) ** 2)
        cuts = sorted({a for a in cells.solution(k)[1] if a < len(x)})
        out.append([float(np.average(x[a:b], weights=w[a:b])) for a, b in zip(cuts, [*cuts[1:], len(x)])])
    return out


def _component_sums(
    data: DataFrame, starts: list[list[str]], hard: list[list[float]] | None, origin: float
) -> list[tuple[Sums, float]]:
    """Size, mean and variance of each component and the summed score, of all starts by one job.

    A start is given by its components' log densities, or at first by ``hard`` centers that
    take each value wholly.
    """
    step = data.selectExpr("x", "w", f"x - {origin!r}D AS gap")
    counts = [len(s) for s in (hard or starts)]
    if hard:
        shares = []
        for j, centers in enumerate(hard):
            cuts = [f"int(x > {(a + b) / 2!r}D)" for a, b in zip(centers, centers[1:])]
            step = step.selectExpr("*", f"{' + '.join(cuts) or '0'} AS own{j}", f"0D AS score{j}")
            shares += [f"double(own{j} = {i}) * w AS r{j}_{i}" for i in range(len(centers))]
    else:
        step = step.selectExpr("*", *[f"{part} AS log{j}_{i}" for j, logs in enumerate(starts) for i, part in enumerate(logs)])
        names = [[f"log{j}_{i}" for i in range(k)] for j, k in enumerate(counts)]
        step = step.selectExpr("*", *[f"{_log_sum(logs)} AS score{j}" for j, logs in enumerate(names)])
        shares = [f"exp(log{j}_{i} - score{j}) * w AS r{j}_{i}" for j, k in enumerate(counts) for i in range(k)]
    sums = [f"sum(score{j} * w) AS score{j}" for j in range(len(counts))]
    for j, k in enumerate(counts):
        for i in range(k):
            r = f"r{j}_{i}"
            sums += [f"sum({r}) AS n{j}_{i}", f"sum({r} * gap) AS s{j}_{i}", f"sum({r} * gap * gap) AS q{j}_{i}"]
    row = step.selectExpr("gap", "w", *[f"score{j}" for j in range(len(counts))], *shares).selectExpr(*sums).first()
    found = []
    for j, k in enumerate(counts):
        n, s, q = (np.array([row[f"{name}{j}_{i}"] for i in range(k)]) for name in "nsq")
        n = np.maximum(n, 1e-15)
        variance = np.maximum(q / n - (s / n) ** 2, 0.0) + VARIANCE_FLOOR
        found.append(((n, origin + s / n, variance), row[f"score{j}"]))
    return found


def _iterate(
    data: DataFrame, starts: list[list[float]], origin: float, rows: int, logs_of, max_iter: int
) -> tuple[Sums, float]:
    """Alternate expectation and maximisation from hard-assigned centers; the best of all starts.

    ``logs_of(n, mean, variance)`` gives each component's weighted log density of x. An
    iteration is one job over the weighted points, shared by all starts that still move, and
    only three sums per component reach the driver, so the plan never grows. A start rests
    when its mean score per row changes less than the tolerance. The score returned is that of
    the parameters returned.
    """
    states = [sums for sums, _ in _component_sums(data, [], starts, origin)]
    scores: list[float | None] = [None] * len(states)
    scored = list(states)
    moving = list(range(len(states)))
    for _ in range(max_iter):
        logs = [logs_of(*states[j]) for j in moving]
        still = []
        for j, (sums, score) in zip(moving, _component_sums(data, logs, None, origin)):
            if scores[j] is None or abs(score - scores[j]) >= TOLERANCE * rows:
                still.append(j)
            scored[j], scores[j], states[j] = states[j], score, sums
        moving = still
        if not moving:
            break
    best = max(range(len(states)), key=lambda j: scores[j])
    return scored[best], scores[best]


def _normal_logs(rows: int):
    def of(n, mean, variance):
        fixed = np.log(n / rows) - 0.5 * np.log(2 * np.pi * variance)
        return [_normal_log(*part) for part in zip(fixed, mean, variance)]

    return of


def _fit(df: DataFrame, col: str, k: int, restarts: int, logs_for, max_iter: int):
    """Prepare weighted points and starts and iterate; ``logs_for(facts)`` makes ``logs_of``."""
    values = column_values(df, col)
    facts = summarise(values)
    data = distinct_points(values).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return facts, *_iterate(data, _start_centers(data, k, restarts), facts.mean, facts.n, logs_for(facts), max_iter)
    finally:
        data.unpersist()


def fit_mixture(df: DataFrame, col: str, k: int = COMPONENTS, restarts: int = 1, max_iter: int = 100) -> Mixture:
    """Maximum-likelihood mixture; of several restarts the likeliest.

    Every start and every iteration sees all rows; equal values enter as one weighted point
    (on a continuous column these are all rows).
    """
    known, wanted = _shared.get(), (id(df), col, k, restarts, max_iter)
    if known is not None and wanted in known:
        return known[wanted]
    _, (n, mean, variance), score = _fit(df, col, k, restarts, lambda facts: _normal_logs(facts.n), max_iter)
    found = _ordered(n / n.sum(), mean, np.sqrt(variance), score)
    if known is not None:
        known[wanted] = found
    return found


_shared: ContextVar[dict[tuple, Mixture] | None] = ContextVar("shared_fits", default=None)


@contextmanager
def shared_fits():
    """Within the block, and its thread, fits of the same frame object with the same settings are made once."""
    token = _shared.set({})
    try:
        yield
    finally:
        _shared.reset(token)


def parameters(df: DataFrame, mixture: Mixture) -> DataFrame:
    rows = [(i, *p) for i, p in enumerate(zip(mixture.weights, mixture.means, mixture.sds))]
    return df.sparkSession.createDataFrame(rows, "component int, weight double, mean double, sd double")


def density_curve(df: DataFrame, col: str, mixture: Mixture, size: int = GRID) -> DataFrame:
    facts = summarise(column_values(df, col))
    return grid_points(df, facts, size).withColumn("density", mixture.density(F.col("x")))


def component_curves(df: DataFrame, col: str, mixture: Mixture, size: int = GRID) -> DataFrame:
    """(i, x, component, density, responsibility); the whole density has component -1."""
    curve = density_curve(df, col, mixture, size)
    total = F.col("density")
    rows = [F.struct(F.lit(-1).alias("component"), total.alias("density"), F.lit(1.0).alias("responsibility"))]
    for i, part in enumerate(mixture.parts(F.col("x"))):
        share = F.when(total > 0, part / total).otherwise(F.lit(0.0))
        rows.append(F.struct(F.lit(i).alias("component"), part.alias("density"), share.alias("responsibility")))
    return curve.select("i", "x", F.explode(F.array(*rows)).alias("part")).select("i", "x", "part.*")


def mixture_analysis(df: DataFrame, col: str, k: int = COMPONENTS, **fit) -> DataFrame:
    return component_curves(df, col, fit_mixture(df, col, k, **fit))


def em_parameters(df: DataFrame, col: str, k: int = COMPONENTS, restarts: int = 5, **fit) -> DataFrame:
    return parameters(df, fit_mixture(df, col, k, restarts=restarts, **fit))


def finite_mixture_curve(df: DataFrame, col: str, k: int = COMPONENTS, **fit) -> DataFrame:
    return density_curve(df, col, fit_mixture(df, col, k, **fit))


def mixture_labels(df: DataFrame, col: str, k: int = COMPONENTS, out: str = "label", **fit) -> DataFrame:
    """Each row's component, numbered by mean; null for missing values."""
    mixture = fit_mixture(df, col, k, **fit)
    x = drop_nan(F.col(col))
    return df.withColumn(out, F.when(x.isNotNull(), mixture.label(x)))


def kmeans_centers(df: DataFrame, col: str, k: int = COMPONENTS, seed: int = 42, exact: bool = True) -> DataFrame:
    """(cluster, center) in order of value: the best k clusters there are, or where one run of MLlib's k-means ends."""
    if exact:
        return exact_kmeans(df, col, k).select("cluster", "center")
    values = column_values(df, col)
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(distinct_points(values)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = KMeans(k=k, seed=seed, featuresCol="features", weightCol="w").fit(data)
    finally:
        data.unpersist()
    centers = sorted(float(c[0]) for c in model.clusterCenters())
    return df.sparkSession.createDataFrame(list(enumerate(centers)), "cluster int, center double")


# -- variational fit ---------------------------------------------------------------------

def _digamma(x: np.ndarray) -> np.ndarray:
    """Digamma by upward recurrence to 6 and the asymptotic series."""
    x = np.array(x, dtype=float)
    shift = np.zeros_like(x)
    while (x < 6).any():
        small = x < 6
        shift[small] -= 1 / x[small]
        x = np.where(small, x + 1, x)
    r = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240)))


@dataclass
class _Posterior:
    """Posterior of stick-breaking weights, means and variances."""

    log_weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    freedom: np.ndarray
    precision: np.ndarray
    weights: np.ndarray
    sticks: tuple[np.ndarray, np.ndarray]
    bounds: tuple[float, ...] = ()  # the evidence lower bound, up to a constant, after each iteration

    @staticmethod
    def update(n: np.ndarray, mean: np.ndarray, scatter: np.ndarray, prior_mean: float, prior_variance: float):
        k = len(n)
        n = n + 1e-15
        precision = 1.0 + n
        freedom = 1.0 + n
        means = (prior_mean + n * mean) / precision
        variances = (prior_variance + n * (scatter + (mean - prior_mean) ** 2 / precision)) / freedom
        a, b = 1.0 + n, 1.0 / k + np.append(np.cumsum(n[::-1])[-2::-1], 0.0)
        both = _digamma(a + b)
        log_rest = np.append(0.0, np.cumsum(_digamma(b) - both)[:-1])
        rest = np.append(1.0, np.cumprod(b / (a + b))[:-1])
        weights = a / (a + b) * rest
        return _Posterior(
            _digamma(a) - both + log_rest, means, variances, freedom, precision, weights / weights.sum(), (a, b)
        )

    def fixed(self) -> np.ndarray:
        """The expected log density of each component, weight included, at its mean."""
        return (
            self.log_weights
            - 0.5 * np.log(2 * np.pi * self.variances)
            - 0.5 * np.log(self.freedom)
            + 0.5 * (math.log(2) + _digamma(0.5 * self.freedom) - 1 / self.precision)
        )

    def log_parts(self) -> list[str]:
        return [_normal_log(*part) for part in zip(self.fixed(), self.means, self.variances)]

    def log_norms(self) -> float:
        """The bound without its entropy: log normalisers of the sticks, the variances and the means."""
        a, b = self.sticks
        half = 0.5 * self.freedom
        sticks = _log_gamma(a) + _log_gamma(b) - _log_gamma(a + b)
        spreads = _log_gamma(half) + half * math.log(2) - half * np.log(self.variances * self.freedom)
        return float((sticks + spreads - 0.5 * np.log(self.precision)).sum())


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in x])


def _entropy(posterior: _Posterior, sums: Sums, score: float) -> float:
    """-sum of r ln r over all rows, from the sums that the responsibilities r of this posterior gave."""
    n, mean, variance = sums
    spread = variance - VARIANCE_FLOOR + (mean - posterior.means) ** 2
    return score - float((n * (posterior.fixed() - spread / (2 * posterior.variances))).sum())


def fit_variational(df: DataFrame, col: str, k: int = COMPONENTS, max_iter: int = 100, tolerance: float = 1e-5) -> _Posterior:
    """Variational mixture with Dirichlet-process weights; it rests when the bound per row gains less than the tolerance."""
    values = column_values(df, col)
    facts = summarise(values)
    prior = (facts.mean, max(facts.sd**2, VARIANCE_FLOOR))
    data = distinct_points(values).persist(StorageLevel.MEMORY_AND_DISK)
    bounds: list[float] = []
    try:
        ((sums, _),) = _component_sums(data, [], _start_centers(data, k, 1), facts.mean)
        posterior = _Posterior.update(*sums, *prior)
        for _ in range(max_iter):
            ((sums, score),) = _component_sums(data, [posterior.log_parts()], None, facts.mean)
            entropy = _entropy(posterior, sums, score)
            posterior = _Posterior.update(*sums, *prior)
            bounds.append(entropy + posterior.log_norms())
            if len(bounds) > 1 and bounds[-1] - bounds[-2] < tolerance * facts.n:
                break
    finally:
        data.unpersist()
    return replace(posterior, bounds=tuple(bounds))


def bayesian_parameters(df: DataFrame, col: str, k: int = COMPONENTS, **fit) -> DataFrame:
    """(component, weight, mean, sd, iterations, bound) of the variational mixture in order of the means."""
    found = fit_variational(df, col, k, **fit)
    rows = sorted(zip(found.means.tolist(), found.weights.tolist(), np.sqrt(found.variances).tolist()))
    rows = [(i, w, m, s, len(found.bounds), found.bounds[-1]) for i, (m, w, s) in enumerate(rows)]
    return df.sparkSession.createDataFrame(rows, "component int, weight double, mean double, sd double, iterations int, bound double")


def bayesian_curve(df: DataFrame, col: str, k: int = COMPONENTS, size: int = GRID, **fit) -> DataFrame:
    """(i, x, density) of the variational mixture."""
    posterior = fit_variational(df, col, k, **fit)
    facts = summarise(column_values(df, col))
    return grid_points(df, facts, size).selectExpr("i", "x", f"exp({_log_sum(posterior.log_parts())}) AS density")
