"""Exact quantiles without gathering a column in one task.

``percentile`` keeps every distinct value of a group in one task. So each wanted order
statistic is first enclosed between two values by mergeable quantile sketches and exact
counts; the scan repeats inside the enclosure until no more rows are left in it than a sketch
resolves. The aggregate expressions returned then read only those values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SKETCH_ACCURACY = 10_000


@dataclass
class _Target:
    """An order statistic (0-based rank) known to lie strictly between ``low`` and ``high``."""

    column: str
    rank: int
    rows: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def inside(self) -> Column:
        c = F.col(self.column)
        bounds = c.isNotNull()
        if self.low is not None:
            bounds = bounds & (c > self.low)
        if self.high is not None:
            bounds = bounds & (c < self.high)
        return bounds

    def expression(self) -> Column:
        if self.value is not None:
            return F.lit(float(self.value))
        share = (self.rank - self.below) / (self.rows - 1) if self.rows > 1 else 0.0
        return F.percentile(F.when(self.inside(), F.col(self.column)), share)


def _spans(places: list[float], accuracy: int) -> list[Column]:
    """Two levels around each place, apart by more than a sketch's error."""
    margin = 2.0 / accuracy
    return [F.lit(x) for p in places for x in (max(p - margin, 0.0), min(p + margin, 1.0))]


def _sketch(df: DataFrame, targets: list[_Target], accuracy: int) -> dict[int, list[float]]:
    """Two values around each open target, by one sketch per column and enclosure."""
    sharing: dict[tuple, list[_Target]] = {}
    for t in targets:
        sharing.setdefault((t.column, t.low, t.high), []).append(t)
    sketches = []
    for i, group in enumerate(sharing.values()):
        places = [(t.rank - t.below) / max(t.rows - 1, 1) for t in group]
        values = F.when(group[0].inside(), F.col(group[0].column))
        sketches.append(F.percentile_approx(values, F.array(*_spans(places, accuracy)), accuracy).alias(f"s{i}"))
    row = df.agg(*sketches).first()
    return {id(t): row[f"s{i}"][2 * j : 2 * j + 2] for i, group in enumerate(sharing.values()) for j, t in enumerate(group)}


def _narrow(df: DataFrame, targets: list[_Target], found: dict[int, list[float]]) -> None:
    """Shrink every target's enclosure to one side of its two values by one counting pass."""
    counts = []
    for i, t in enumerate(targets):
        c, (a, b) = F.col(t.column), found[id(t)]
        inside = t.inside()
        counts += [
            F.count_if(inside & (c < a)).alias(f"lt_a{i}"),
            F.count_if(inside & (c == a)).alias(f"eq_a{i}"),
            F.count_if(inside & (c < b)).alias(f"lt_b{i}"),
            F.count_if(inside & (c == b)).alias(f"eq_b{i}"),
        ]
    n = df.agg(*counts).first()
    for i, t in enumerate(targets):
        a, b = found[id(t)]
        place = t.rank - t.below
        lt_a, eq_a, lt_b, eq_b = (n[f"{name}{i}"] for name in ("lt_a", "eq_a", "lt_b", "eq_b"))
        if place < lt_a:
            t.high, t.rows = a, lt_a
        elif place < lt_a + eq_a:
            t.value = a
        elif place < lt_b:
            t.low, t.high, t.below, t.rows = a, b, t.below + lt_a + eq_a, lt_b - lt_a - eq_a
        elif place < lt_b + eq_b:
            t.value = b
        else:
            t.low, t.below, t.rows = b, t.below + lt_b + eq_b, t.rows - lt_b - eq_b


def quantile_columns(
    df: DataFrame,
    columns: Sequence[str],
    shares: Sequence[float],
    accuracy: int = SKETCH_ACCURACY,
) -> dict[tuple[str, float], Column]:
    """Aggregate expressions of exact, linearly interpolated quantiles, for use in ``df.agg``."""
    first = []
    for i, c in enumerate(columns):
        sketch = F.percentile_approx(F.col(c), F.array(*_spans(list(shares), accuracy)), accuracy)
        first += [F.count(c).alias(f"n{i}"), sketch.alias(f"s{i}")]
    row = df.agg(*first).first()
    result: dict[tuple[str, float], Column] = {}
    pairs: dict[tuple[str, float], tuple[_Target, _Target, float]] = {}
    targets: dict[tuple[str, int], _Target] = {}
    found: dict[int, list[float]] = {}
    for i, c in enumerate(columns):
        rows = row[f"n{i}"]
        if not rows:
            result |= {(c, share): F.lit(None).cast("double") for share in shares}
            continue
        for j, share in enumerate(shares):
            position = share * (rows - 1)
            ends = [targets.setdefault((c, r), _Target(c, r, rows)) for r in (math.floor(position), math.ceil(position))]
            found |= {id(t): row[f"s{i}"][2 * j : 2 * j + 2] for t in ends}
            pairs[c, share] = (ends[0], ends[1], position - math.floor(position))
    while open_targets := [t for t in targets.values() if t.value is None and t.rows > accuracy]:
        _narrow(df, open_targets, found or _sketch(df, open_targets, accuracy))
        found = {}
    for key, (lower, upper, fraction) in pairs.items():
        result[key] = lower.expression() * (1 - fraction) + upper.expression() * fraction
    return result
