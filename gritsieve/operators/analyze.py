"""All analyses of one column by name, and one table that sums them up."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gritsieve.operators import clusters, density, mixture, outliers
from gritsieve.operators.dbscan import dbscan_labels
from gritsieve.operators.histogram import histogram_peaks

Analysis = Callable[[DataFrame, str], DataFrame]

_ANALYSES: dict[str, Analysis] = {}
_MARKS: dict[str, tuple[str, Callable[[DataFrame, str], DataFrame]]] = {}


def register_analysis(name: str, analysis: Analysis, kind: str = "curve", marks: Analysis | None = None) -> None:
    """Add an analysis.

    ``marks`` turns its result into (position, value) rows for the summary: the peak of a
    curve, the centers, or the labels with their sizes.
    """
    _ANALYSES[name] = analysis
    _MARKS[name] = (kind, marks or _curve_top)


def analyses() -> list[str]:
    return list(_ANALYSES)


def _curve_top(result: DataFrame, col: str) -> DataFrame:
    return result.orderBy(F.desc("density"), "x").limit(1).select(F.col("x").alias("position"), F.col("density").alias("value"))


def _marks(position: str, value: str) -> Analysis:
    return lambda result, col: result.select(
        F.col(position).cast("double").alias("position"), F.col(value).cast("double").alias("value")
    )


def _label_sizes(result: DataFrame, col: str) -> DataFrame:
    return result.where("label is not null").groupBy("label").agg(
        F.avg(col).cast("double").alias("position"), F.count(F.lit(1)).cast("double").alias("value")
    ).select("position", "value")


register_analysis("gaussian_mixture", mixture.mixture_analysis)
register_analysis("kernel_density", density.kernel_density)
register_analysis("histogram_peaks", histogram_peaks, "peak", _marks("left_edge", "density"))
register_analysis("density_modes", density.density_modes, "peak", _marks("x", "density"))
register_analysis("em_mixture", mixture.em_parameters, "center", _marks("mean", "weight"))
register_analysis("finite_mixture", mixture.finite_mixture_curve)
register_analysis("non_parametric", density.scott_density)
register_analysis("mean_shift", clusters.mean_shift_centers, "center", _marks("center", "n_within"))
register_analysis("kmeans", mixture.kmeans_centers, "center", _marks("center", "cluster"))
register_analysis("dbscan", dbscan_labels, "label", _label_sizes)
register_analysis("agglomerative", clusters.ward_labels, "label", _label_sizes)
register_analysis("mixture_labels", mixture.mixture_labels, "label", _label_sizes)
register_analysis("isolation_forest", outliers.isolation_labels, "label", _label_sizes)
register_analysis("bayesian_mixture", mixture.bayesian_curve)
register_analysis("self_organising_map", clusters.self_organising_map, "center", _marks("weight", "unit"))


BUILT_IN = tuple(_ANALYSES)


def analyze(df: DataFrame, col: str, methods: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Result table of every named analysis (default: all)."""
    names = list(methods) if methods is not None else analyses()
    unknown = [n for n in names if n not in _ANALYSES]
    if unknown:
        raise ValueError(f"unknown analyses: {unknown}")
    with mixture.shared_fits():
        return {name: _ANALYSES[name](df, col) for name in names}


def analyze_one(df: DataFrame, col: str, index: int) -> DataFrame:
    """The analysis at a 0-based position of the registry."""
    return _ANALYSES[analyses()[index]](df, col)


def summary(df: DataFrame, col: str, methods: Sequence[str] | None = None) -> DataFrame:
    """(method, kind, position, value) of all named analyses."""
    rows = []
    for name, result in analyze(df, col, methods).items():
        kind, marks = _MARKS[name]
        rows.append(marks(result, col).select(F.lit(name).alias("method"), F.lit(kind).alias("kind"), "position", "value"))
    return reduce(DataFrame.unionByName, rows)
