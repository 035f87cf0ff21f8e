"""Exact k-means of one column: the least sum of squares over all ways to cut the axis.

In one dimension the best clusters are intervals, so a solution is k - 1 cuts. The column is
summed up into cells of the axis; a dynamic program over cell borders gives a solution, another
one that lets the cells around the cuts go for free gives what no solution can beat. Cells
where a cut would cost more than the best solution are out; the others are cut finer, until
each holds one value. What is kept of each round is the cells, never the values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from gritsieve.operators.histogram import column_values, summarise
from gritsieve.operators.points import distinct_points

CELLS = 4096
SLACK = 1e-9  # of the total sum of squares, for rounding


def _best_splits(last: np.ndarray, cost) -> tuple[np.ndarray, np.ndarray]:
    """For each j the least last[i] + cost(i, j) over i <= j, and the i.

    The best i never falls as j grows, so it is found for the middle j of every open stretch,
    level by level, all stretches of a level at once.
    """
    n = len(last)
    best, at = np.full(n, np.inf), np.zeros(n, np.int64)
    low, high, first, final = (np.array([v]) for v in (0, n - 1, 0, n - 1))
    while len(low):
        mid = (low + high) // 2
        final_here = np.minimum(final, mid)
        sizes = final_here - first + 1
        starts = np.cumsum(sizes) - sizes
        i = np.arange(sizes.sum()) - np.repeat(starts - first, sizes)
        total = last[i] + cost(i, np.repeat(mid, sizes))
        least = np.minimum.reduceat(total, starts)
        hits = np.flatnonzero(total == np.repeat(least, sizes))
        chosen = i[hits[np.searchsorted(hits, starts)]]
        best[mid], at[mid] = least, chosen
        left, right = low < mid, mid < high
        low, high, first, final = (
            np.r_[low[left], mid[right] + 1],
            np.r_[mid[left] - 1, high[right]],
            np.r_[first[left], chosen[right]],
            np.r_[chosen[left], final[right]],
        )
    return best, at


@dataclass
class Cells:
    """Consecutive stretches of the axis: least and greatest value, weight, sum and sum of squares of each."""

    low: np.ndarray
    high: np.ndarray
    w: np.ndarray
    s: np.ndarray
    q: np.ndarray

    def __post_init__(self):
        self.sums = [np.r_[0.0, np.cumsum(v)] for v in (self.w, self.s, self.q)]

    def cost(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Sum of squares of cells i to j - 1 around their mean; 0 where there are none."""
        w, s, q = (v[np.maximum(i, j)] - v[i] for v in self.sums)
        return np.maximum(q - s * s / np.where(w > 0, w, 1.0), 0.0)

    def solution(self, k: int) -> tuple[float, list[int]]:
        """The least cost with cuts between cells, and the border before each cluster."""
        n = len(self.w)
        best = np.r_[0.0, np.full(n, np.inf)]
        back = []
        for _ in range(k):
            best, at = _best_splits(best, self.cost)
            back.append(at)
        cuts, j = [], n
        for at in reversed(back):
            j = int(at[j])
            cuts.append(j)
        return float(best[n]), cuts[::-1]

    def _from_left(self, k: int) -> list[np.ndarray]:
        """For m = 1 .. k - 1 the least cost before each cell if the m-th cut lies in it."""
        n = len(self.w)
        out = [self.cost(np.zeros(n, np.int64), np.arange(n))]
        for _ in range(k - 2):
            # the next cut may lie in the same cell, at no further cost
            out.append(_best_splits(out[-1], lambda i, j: self.cost(np.minimum(i + 1, j), j))[0])
        return out

    def may_hold_a_cut(self, k: int, limit: float) -> np.ndarray:
        """Cells in which some cut of a solution within the limit can lie: the rest of both sides alone must not cost more."""
        flipped = Cells(-self.high[::-1], -self.low[::-1], self.w[::-1], -self.s[::-1], self.q[::-1])
        left, right = self._from_left(k), [v[::-1] for v in flipped._from_left(k)]
        least = np.min([left[m] + right[k - 2 - m] for m in range(k - 1)], axis=0)
        return least <= limit


def _summed(data: DataFrame, borders: np.ndarray, wanted: np.ndarray, origin: float) -> Cells:
    """Sums of the values in each wanted cell; cell c takes values above borders[c] up to borders[c + 1]."""
    sent = data.sparkSession.sparkContext.broadcast((borders, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, asked = sent.value
        n = len(edges) - 1
        low, high = np.full(n, np.inf), np.full(n, -np.inf)
        w, s, q = np.zeros(n), np.zeros(n), np.zeros(n)
        for batch in batches:
            x, weight = (batch.column(c).to_numpy() for c in ("x", "w"))
            cell = np.searchsorted(edges, x, "left") - 1
            kept = (cell >= 0) & (cell < n)
            kept[kept] = asked[cell[kept]]
            x, weight, cell = x[kept], weight[kept], cell[kept]
            gap = x - origin
            w += np.bincount(cell, weight, n)
            s += np.bincount(cell, weight * gap, n)
            q += np.bincount(cell, weight * gap * gap, n)
            np.minimum.at(low, cell, x)
            np.maximum.at(high, cell, x)
        some = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(v[some]) for v in (low, high, w, s, q))], ["c", "low", "high", "w", "s", "q"])

    parts = data.mapInArrow(run, "c long, low double, high double, w double, s double, q double")
    found = parts.groupBy("c").agg({"low": "min", "high": "max", "w": "sum", "s": "sum", "q": "sum"}).orderBy("c").toArrow()
    return Cells(*(found[f"{f}({c})"].to_numpy() for c, f in (("low", "min"), ("high", "max"), ("w", "sum"), ("s", "sum"), ("q", "sum"))))


def _finer(data: DataFrame, cells: Cells, open_: np.ndarray, origin: float) -> tuple[Cells, np.ndarray]:
    """Open cells cut into steps of equal width and summed anew, runs of closed cells as one; and which cells are closed."""
    first = np.flatnonzero(np.r_[True, open_[1:] | open_[:-1]])
    last = np.r_[first[1:], len(open_)] - 1
    closed = ~open_[first]
    merged = Cells(cells.low[first], cells.high[last], *(np.add.reduceat(getattr(cells, c), first) for c in "wsq"))
    split = ~closed & (merged.low < merged.high)
    steps = max(2, CELLS // max(1, int(split.sum())))
    borders, wanted = [], []
    for low, high in zip(merged.low[split].tolist(), merged.high[split].tolist()):
        inner = low + (high - low) * (np.arange(1, steps) / steps)
        # the border below the stretch, its steps, its end: what lies between two stretches is not asked for
        edges = np.unique(np.r_[np.nextafter(low, -np.inf), inner[(inner >= low) & (inner < high)], high])
        borders.append(edges)
        wanted.append(np.r_[np.ones(len(edges) - 1, bool), False])
    fine = _summed(data, np.concatenate(borders), np.concatenate(wanted)[:-1], origin)
    order = np.argsort(np.r_[merged.low[~split], fine.low], kind="stable")
    columns = [np.r_[getattr(merged, c)[~split], getattr(fine, c)][order] for c in ("low", "high", "w", "s", "q")]
    return Cells(*columns), np.r_[closed[~split], np.zeros(len(fine.w), bool)][order]


def best_cells(data: DataFrame, k: int, low: float, high: float, origin: float) -> tuple[Cells, list[int], float]:
    """Cells whose borders hold a best solution, the first cell of each cluster, and the cost."""
    edges = np.unique(np.r_[np.nextafter(low, -np.inf), np.linspace(low, high, CELLS + 1)[1:-1], high])
    cells = _summed(data, edges, np.ones(len(edges) - 1, bool), origin)
    closed = np.zeros(len(cells.w), bool)
    while True:
        cost, cuts = cells.solution(k)
        if k == 1:
            return cells, cuts, cost
        slack = SLACK * max(float(cells.q.sum()), 1e-300)
        open_ = cells.may_hold_a_cut(k, cost + slack) & ~closed  # what is closed once has no cut
        if not (open_ & (cells.low < cells.high)).any():
            return cells, cuts, cost
        cells, closed = _finer(data, cells, open_, origin)


def exact_kmeans(df: DataFrame, col: str, k: int) -> DataFrame:
    """(cluster, center, size, upto, cost) of the best k clusters in order: their mean, rows, greatest value and sum of squares.

    Missing values take no part; with fewer distinct values than k there are as many clusters
    as values. Each round is one pass over the distinct values and collects at most about
    ``CELLS`` cells and one for each cell a cut may lie in, whose number grows with the square
    root of the values at most, as costs are flat around their minimum.
    """
    values = column_values(df, col)
    facts = summarise(values)
    data = distinct_points(values).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cells, cuts, _ = best_cells(data, k, facts.lo, facts.hi, facts.mean)
    finally:
        data.unpersist()
    starts = sorted(set(cuts))
    starts = [a for a in starts if a < len(cells.w)]
    ends = [*starts[1:], len(cells.w)]
    rows = []
    for i, (a, b) in enumerate(zip(starts, ends)):
        w, s = float(cells.w[a:b].sum()), float(cells.s[a:b].sum())
        cost = float(cells.cost(np.array([a]), np.array([b]))[0])
        rows.append((i, facts.mean + s / w, int(round(w)), float(cells.high[b - 1]), cost))
    return df.sparkSession.createDataFrame(rows, "cluster int, center double, size bigint, upto double, cost double")
