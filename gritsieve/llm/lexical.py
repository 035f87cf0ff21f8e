"""Ranked lexical search over posting lists blocked by document similarity.

Documents become sparse rows over the terms of the queries. A task holds a bounded segment of
them and answers all queries of a block on it: the posting list of a term is cut into clusters
of similar documents, each cluster keeps the coordinatewise maximum of its rows, and a cluster
is passed over only if the query's exact score of that maximum cannot reach the best k so far.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritsieve.llm.common import query, slices, stored, table, union, worker_cache, written

# letters A-Z lowered, all other ASCII but letters and digits a blank; bytes of other letters stay
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
GRAIN = 1_000_000_000
HELD = 1 << 21  # coordinates of summaries a task keeps, 16 bytes each
VALUE_BITS = 20  # impacts stay below 1,000,000
NO_ID = np.iinfo(np.int64).max


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of letters, digits and non-ASCII characters in order."""
    return text.translate(FOLD).split()


def weight_of(n_docs: int, df: int) -> int:
    """A term's weight; 0 for a term of no document, as it can add nothing."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) if df else 0


def impacts(tf: np.ndarray, n: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each posting adds to a score per unit of weight, below 1,000,000; documents of n terms have ``lengths`` postings."""
    m = np.array([10 + 90 * x * n_docs // n_terms for x in n.tolist()], np.int64)
    return GRAIN * tf // (1000 * tf + 8 * np.repeat(m, lengths))


@dataclass
class Queries:
    """Term numbers and weights of each query of a block, best bound first."""

    terms: list[np.ndarray]
    weights: list[np.ndarray]
    size: int  # number of distinct terms
    floor: np.ndarray | None = None  # scores that at least k documents are known to reach


class Blocks:
    """One posting list cut into clusters, and the clusters' summaries."""

    def __init__(self, docs: np.ndarray, segment: Segment):
        n = -(-len(docs) // segment.block)
        if n > 1:
            near = segment.sketch[docs] @ segment.sketch[docs[:: -(-len(docs) // n)]].T
            cluster = near.argmax(1)
            order = np.argsort(cluster, kind="stable")
            docs, cluster = docs[order], cluster[order]
            self.starts = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1]])
        else:
            self.starts = np.zeros(1, np.int64)
        self.docs = docs
        self.sizes = np.diff(np.r_[self.starts, len(docs)])
        places, lengths = segment.places(docs)
        block = np.repeat(np.repeat(np.arange(len(self.starts)), self.sizes), lengths)
        # a coordinate and its value in one number, so that the last of equal coordinates is the largest
        packed = np.sort((block * segment.size + segment.terms[places]) << VALUE_BITS | segment.values[places])
        keys = packed >> VALUE_BITS
        last = np.flatnonzero(np.r_[keys[1:] != keys[:-1], True])
        self.keys, self.maxima = keys[last], packed[last] & ((1 << VALUE_BITS) - 1)
        self.size = segment.size

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The query's score of every cluster's summary: no member scores more."""
        wanted = np.arange(len(self.starts))[:, None] * self.size + terms[None, :]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.maxima[at] * weights[None, :], 0).sum(1)


class Segment:
    """Rows of some documents by document and by term."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, values: np.ndarray, size: int, block: int, width: int = 32):
        self.size, self.block = size, block
        self.offsets = np.r_[0, np.cumsum(lengths)].astype(np.int64)
        self.terms, self.values = terms.astype(np.int64), values
        doc = np.repeat(np.arange(len(lengths)), lengths)
        order = np.argsort(self.terms, kind="stable")
        self.by_term = doc[order]
        self.cuts = np.searchsorted(self.terms[order], np.arange(size + 1))
        self.peak = np.zeros(size, np.int64)
        held = np.flatnonzero(np.diff(self.cuts))
        if len(held):
            self.peak[held] = np.maximum.reduceat(values[order], self.cuts[:-1][held])
        # documents as short dense rows, used only to say which are alike
        signs = np.random.default_rng(11).choice(np.float32([-1, 1]), (size, width))
        self.sketch = np.zeros((len(lengths), width), np.float32)
        some = np.flatnonzero(lengths)
        if len(some):
            for w in range(width):
                self.sketch[some, w] = np.add.reduceat(signs[self.terms, w] * values.astype(np.float32), self.offsets[:-1][some])
        self.sketch /= np.maximum(np.linalg.norm(self.sketch, axis=1, keepdims=True), 1e-9)
        self.built: dict[int, Blocks] = {}
        self.held = 0
        self.dense = np.zeros(size, np.int64)

    def places(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the documents' postings, and how many each has."""
        first, lengths = self.offsets[docs], self.offsets[docs + 1] - self.offsets[docs]
        return np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum()), lengths

    def blocks(self, term: int) -> Blocks:
        """A list is clustered when a query first has to walk it; summaries beyond HELD coordinates are let go and built again."""
        if term not in self.built:
            docs = self.by_term[self.cuts[term] : self.cuts[term + 1]]
            if self.held > HELD:
                self.built, self.held = {}, 0
            self.built[term] = Blocks(docs, self)
            self.held += len(self.built[term].keys)
        return self.built[term]

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Exact scores under the weights in ``dense``."""
        places, lengths = self.places(docs)
        return np.add.reduceat(self.values[places] * self.dense[self.terms[places]], np.cumsum(lengths) - lengths)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best, least: int) -> None:
        """Offer ``best`` every document that may be among the k best; documents below ``least`` are not wanted."""
        gains = weights * self.peak[terms]
        order = np.argsort(-gains, kind="stable")
        rest = np.cumsum(gains[order][::-1])[::-1]
        seen = np.zeros(len(self.offsets) - 1, bool)
        self.dense[terms] = weights
        for i, t in zip(order.tolist(), rest.tolist()):
            bar = max(1, least, best.bar())
            if t < bar:  # documents without the terms so far cannot reach the bar
                break
            blocks = self.blocks(int(terms[i]))
            reach = blocks.bounds(terms, weights) >= bar
            docs = blocks.docs[np.repeat(reach, blocks.sizes)]
            docs = docs[~seen[docs]]
            if len(docs):
                seen[docs] = True
                best.offer(docs, self.scores(docs))
        self.dense[terms] = 0


class Best:
    """The k best of one query: by score, then by id, ids that are null last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.none = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def within(self, ids: np.ndarray, none: np.ndarray) -> Best:
        """Names the documents that are offered by place."""
        self._ids, self._none = ids, none
        return self

    def bar(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def offer(self, docs: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= max(1, self.bar())
        scores = np.r_[self.scores, scores[good]]
        ids, none = np.r_[self.ids, self._ids[docs[good]]], np.r_[self.none, self._none[docs[good]]]
        order = np.lexsort((ids, none, -scores))[: self.k]
        self.scores, self.ids, self.none = scores[order], ids[order], none[order]


FORWARD = "doc_id long, n long, terms array<int>, tfs array<int>"


def forward(docs: DataFrame, vocabulary: list[bytes], key: str, text: str) -> DataFrame:
    """A row for each text with a term: its number of terms, and how often it holds those of the vocabulary."""
    spark = docs.sparkSession
    sent, name = spark.sparkContext.broadcast(vocabulary), uuid.uuid4().hex
    size = len(vocabulary)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = worker_cache(("terms", name), lambda: {t: i for i, t in enumerate(sent.value)})
        for batch in slices(batches, "text"):
            words = [terms_of(t) for t in batch.column("text").to_pylist()]
            n = np.array([len(w) for w in words], np.int64)
            found = np.fromiter((i for w in words for i in map(number.get, w, repeat(-1))), np.int64, int(n.sum()))
            keys, tf = np.unique((np.repeat(np.arange(len(n)), n) * size + found)[found >= 0], return_counts=True)
            offsets = pa.array(np.searchsorted(keys, np.arange(len(n) + 1) * size).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (keys % max(1, size), tf)]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    return rows.mapInArrow(run, FORWARD)


def ranked(rows: DataFrame, queries: Queries, n_docs: int, n_terms: int, k: int, block: int, postings: int) -> DataFrame:
    """(q, doc_id, score): each task's k best for each query number."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best = [Best(k) for _ in asked.terms]

        def answer(held: list[pa.RecordBatch]) -> None:
            part = pa.Table.from_batches(held).combine_chunks()
            lists, tfs = (pa.concat_arrays(part[c].chunks) for c in ("terms", "tfs"))
            lengths = np.diff(lists.offsets.to_numpy())
            values = tfs.flatten().to_numpy().astype(np.int64)
            values = impacts(values, part["n"].to_numpy(), lengths, n_docs, n_terms)
            segment = Segment(lengths, lists.flatten().to_numpy(), values, asked.size, block)
            none = part["doc_id"].is_null().to_numpy()
            ids = part["doc_id"].fill_null(NO_ID).to_numpy()
            for q, (terms, weights) in enumerate(zip(asked.terms, asked.weights)):
                segment.search(terms, weights, best[q].within(ids, none), int(asked.floor[q]) if asked.floor is not None else 0)

        held, size = [], 0
        for batch in slices(batches, "terms", 1 << 22):
            if len(batch):
                held.append(batch)
                size += len(batch) + len(batch.column("terms").flatten())
            if size >= postings:
                answer(held)
                held, size = [], 0
        if held:
            answer(held)
        for q, b in enumerate(best):
            if len(b.scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(b.scores), q)), pa.array(b.ids, pa.int64(), mask=b.none), pa.array(b.scores)], ["q", "doc_id", "score"]
                )

    local = rows.where(F.size("terms") > 0).mapInArrow(run, "q long, doc_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _answer_block(docs: DataFrame, items: list[tuple[object, bytes]], key: str, text: str, k: int, block: int, postings: int, seeds: int) -> DataFrame | None:
    """(q, rank, doc_id, score) of the items of one block."""
    words = [sorted(set(terms_of(t))) for _, t in items]
    vocabulary = sorted({w for ws in words for w in ws})
    number = {w: i for i, w in enumerate(vocabulary)}
    rows = written(forward(docs, vocabulary, key, text), "forward")
    totals = rows.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not totals["docs"]:
        return None
    counts = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df = np.zeros(len(vocabulary), np.int64)
    df[counts["t"].to_numpy()] = counts["df"].to_numpy()
    weight = np.array([weight_of(totals["docs"], int(x)) for x in df], np.int64)
    terms = [np.array([i for i in map(number.get, ws) if weight[i]], np.int64) for ws in words]
    queries = Queries(terms, [weight[t] for t in terms], len(vocabulary))
    find = lambda rows, k_rows: ranked(rows, queries, totals["docs"], totals["terms"], k_rows, block, postings)
    # the k-th best of any k documents is a score that the answer reaches, so a few documents give every task a bar
    share = (1 << 30) * seeds // totals["docs"]
    if share < (1 << 30):
        few = rows.where(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(1 << 30)) < share)
        queries.floor = np.zeros(len(items), np.int64)
        for r in find(few, k).where(F.col("rank") == k).select("q", "score").collect():
            queries.floor[r["q"]] = r["score"]
    return find(rows, k)


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    k: int = 10,
    block: int = 16,
    postings: int = 1 << 18,
    block_bytes: int = 4 << 20,
    block_items: int = 1 << 14,
    seeds: int = 4096,
) -> DataFrame:
    """(item key, rank, key, score): the k best documents with a score above 0 for each item row, exactly.

    Items are dealt into blocks of about ``block_bytes`` of text or ``block_items`` rows, so
    what travels to the tasks (an item block's terms and weights) and comes back to the driver
    (one document count a term) is bounded by these two, never by the tables. For each block
    every document is read once; its sparse rows are written to a shared folder, counted, and
    searched in segments of about ``postings`` postings. A task keeps k rows an item from
    segment to segment. ``seeds`` documents drawn by hash give a first bar; they change what is
    skipped, not the answer. ``block`` is the aimed-at number of documents of a cluster.

    Null and termless texts take no part, nor in the counts; a text of any length is one
    document; repeated rows are documents of their own, so equal rows fill several ranks; ties
    go to the smaller key, null keys last. An item without a term, or whose terms stand in no
    document or in all of them, has no rows; each row of a repeated item key is answered by itself. Empty
    tables give no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_key).alias("item"), F.col(item_text).cast("string").cast("binary").alias("words"))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("bytes")).first()
    n_blocks = max(1, -(-size["n"] // block_items), -(-size["bytes"] // block_bytes))
    asked = stored(asked.withColumn("b", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks))))
    kind = asked.schema["item"].dataType.simpleString()
    schema = f"`{item_key}` {kind}, rank int, `{key}` long, score long"
    parts = []
    for b in range(n_blocks):
        chosen = [(r["item"], bytes(r["words"])) for r in asked.where(F.col("b") == b).where("words IS NOT NULL").collect()]
        found = _answer_block(docs, chosen, key, text, k, block, postings, seeds) if chosen else None
        if found is None:
            continue
        names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(chosen)], f"q long, `{item_key}` {kind}")
        out = found.join(F.broadcast(names), "q").select(item_key, "rank", F.col("doc_id").alias(key), "score")
        parts.append(out if n_blocks == 1 else stored(out))
    return union(parts) if parts else empty(spark, schema)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
e AS (SELECT r, doc_id, len(ts) AS n, ts FROM d WHERE len(ts) > 0),
g AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM e),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM e) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM f, g),
i AS (SELECT row_number() OVER () AS q, item_id, text FROM benchmark WHERE text IS NOT NULL),
t AS (SELECT DISTINCT q, unnest({_TERMS}) AS t FROM i),
s AS (SELECT t.q, p.r, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * e.n * g.nd) // g.nt)))) AS BIGINT) AS score
  FROM t JOIN w USING (t) JOIN p USING (t) JOIN e USING (r), g GROUP BY ALL),
o AS (SELECT i.item_id, e.doc_id, s.score, row_number() OVER (PARTITION BY s.q ORDER BY s.score DESC, e.doc_id) AS rank
  FROM s JOIN e USING (r) JOIN i USING (q) WHERE s.score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10
"""


@query("op13_geometric_blocks", _SQL)
def op13_geometric_blocks(spark, folder):
    """The ten best documents of each benchmark item."""
    return rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
