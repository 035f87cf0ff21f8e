"""Exact top-k inner products by term-at-a-time accumulation over blocks of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gritsieve.llm.common import query, stored, table, union

SAFE = 2**62


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row lengths of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy())


def postings(values: np.ndarray, lengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each dimension the rows with a weight other than zero, and the weights."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    dim = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    kept = values != 0
    row, dim, weight = row[kept], dim[kept], values[kept]
    order = np.argsort(dim, kind="stable")
    cuts = np.searchsorted(dim[order], np.arange(int(dim.max()) + 2 if len(dim) else 1))
    return [(row[order[a:b]], weight[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]


def accumulate(queries: list[np.ndarray], lists, n_rows: int) -> Iterator[np.ndarray]:
    """The dense scores of each query: every term of its sparse row scatters its weighted postings."""
    peak = [int(np.abs(w).max()) if len(w) else 0 for _, w in lists]
    for q in queries:
        terms = [t for t in np.flatnonzero(q) if t < len(lists)]
        exact = sum(peak[t] * abs(int(q[t])) for t in terms) < SAFE
        scores = np.zeros(n_rows, np.int64 if exact else object)
        for t in terms:
            rows, weights = lists[t]
            # a row occurs once in a posting list, so the scatter has no clashes
            scores[rows] += weights * q[t] if exact else weights.astype(object) * int(q[t])
        yield scores if exact else np.array([max(-(2**63), min(2**63 - 1, int(s))) for s in scores], np.int64)


def select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k best by score, ties to the smaller id, without the query's own row."""
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], -scores[at].astype(object) if len(at) and scores[at].min() == -(2**63) else -scores[at]))][:k]


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component; rows with null or non-finite components go."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(key).alias("id"), v.alias("x")).where(F.col("id").isNotNull() & v.isNotNull() & finite)
    return rows.select("id", F.transform("x", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def top_k(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, every: int = 100, scale: int = 1024, block: int = 4096
) -> DataFrame:
    """The k best candidates of each query row (key divisible by ``every``), exactly.

    Queries are taken in blocks of about ``block`` rows; each block is sent to all tasks (its
    size is bounded by ``block``) and meets every candidate in one scan without a shuffle. A
    task turns its candidates into posting lists, accumulates whole score arrays and keeps k
    rows per query; the partial lists are merged by query, k rows per batch.

    Vectors that are null or hold null or non-finite components take no part; shorter vectors
    count as padded with zeros; of rows with an equal key each is a candidate of the others'
    queries, none of its own key, and each of their different vectors is a query of its own; scores beyond 64 bits stop at the limits of long. Empty
    tables give no rows; other columns are ignored.
    """
    rows = quantised(vectors, key, vector, scale)
    queries = stored(rows.where(F.col("id") % every == 0).dropDuplicates(["id", "v"]).withColumn("q", F.monotonically_increasing_id()))
    n_blocks = -(-max(1, queries.count()) // block)
    queries = queries.withColumn("b", F.pmod(F.xxhash64("q"), F.lit(n_blocks)))
    spark, parts = vectors.sparkSession, []
    for b in range(n_blocks):
        chosen = queries.where(F.col("b") == b).select("q", "id", "v").toArrow()
        values, lengths = _matrix(pa.concat_arrays(chosen["v"].chunks) if chosen.num_rows else pa.array([], pa.list_(pa.int64())))
        sent = spark.sparkContext.broadcast((chosen["q"].to_numpy(), chosen["id"].to_numpy(), np.split(values, np.cumsum(lengths)[:-1]) if len(lengths) else []))

        def partial(batches, sent=sent):
            numbers, own, vectors = sent.value
            for batch in batches:
                ids = batch.column("id").to_numpy()
                lists = postings(*_matrix(batch.column("v")))
                scores_of, ids_of, query_of, number_of = [], [], [], []
                for q, o, scores in zip(numbers, own, accumulate(vectors, lists, len(ids))):
                    at = select(scores, ids, o, k)
                    query_of.append(np.full(len(at), o))
                    number_of.append(np.full(len(at), q))
                    ids_of.append(ids[at])
                    scores_of.append(scores[at])
                if ids_of:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (number_of, query_of, ids_of, scores_of)], ["q", "query_id", "vec_id", "score"])

        best = rows.mapInArrow(partial, "q long, query_id long, vec_id long, score long")
        parts.append(best if n_blocks == 1 else stored(best))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return union(parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_SQL = """
WITH f AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, unnest(range(len(v))) AS d, unnest(v) AS x FROM f),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM u q JOIN u c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


@query("op9_topk", _SQL)
def op9_topk(spark, folder):
    """The ten best inner products of each hundredth vector."""
    return top_k(table(spark, folder, "embeddings"))
