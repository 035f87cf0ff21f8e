"""Near-duplicate classes by MinHash signatures and a multi-index Hamming join.

A document's signature has one 16-bit symbol per hash function. Two signatures at distance d
(the number of symbols that differ) are cut into chunks; if d is below chunks * (errors + 1),
some chunk differs in at most ``errors`` symbols, so enumerating every choice of ``errors``
wildcards in every chunk gives the pair a common key: no pair under the distance threshold is
missed. Pairs are then confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.common import bitmap_of, components, in_bitmap, in_groups, query, slices, stored, table, worker_cache, written

CHUNK, ERRORS, CHUNKS = 4, 1, 9
SYMBOLS = CHUNK * CHUNKS
WILDCARDS = [c * CHUNK + np.array(kept) for c in range(CHUNKS) for kept in combinations(range(CHUNK), CHUNK - ERRORS)]
THRESHOLD = CHUNKS * (ERRORS + 1) - 1  # the largest distance that is sure to share a key
MISS = 1e-9
BLOCK = 1024
_RNG = np.random.default_rng(5)
FACTORS = _RNG.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 2**63, SYMBOLS, dtype=np.uint64)


def farthest(percent: int, miss: float = MISS) -> int:
    """The least distance that two sets sharing ``percent`` of their union exceed with a chance of at most ``miss``."""
    p = percent / 100
    tail = lambda d: sum(comb(SYMBOLS, k) * (1 - p) ** k * p ** (SYMBOLS - k) for k in range(d + 1, SYMBOLS + 1))
    return max(THRESHOLD, next(d for d in range(SYMBOLS + 1) if tail(d) <= miss))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def worker_words(limit: int = 200_000) -> WordHashes:
    """The word hashes this worker has computed; begun anew when there are ``limit``."""
    known = worker_cache("word hashes", WordHashes)
    if len(known) > limit:
        known.clear()
    return known


def shingles(text: str | None, size: int, known: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of ``size`` words; of all its words if it has fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        out = (out ^ h[j : len(h) - size + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(values: np.ndarray) -> np.ndarray:
    """16 well-mixed bits of the least value under each hash function."""
    out = np.empty(SYMBOLS, np.uint64)
    for i in range(SYMBOLS):
        out[i] = (values * FACTORS[i] + SHIFTS[i]).min()
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    return (out >> np.uint64(48)).astype(np.uint16)


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """A row of keys per signature: number of the wildcard pattern, then the symbols it keeps."""
    out = np.empty((len(signatures), len(WILDCARDS)), np.int64)
    wide = signatures.astype(np.int64)
    for n, kept in enumerate(WILDCARDS):
        key = np.full(len(signatures), n, np.int64)
        for place in kept:
            key = (key << 16) | wide[:, place]
        out[:, n] = key
    return out


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """Rows (at, doc_id, text) -> (at, doc_id, n, digest, sig): size, digest and signature of each shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            known = worker_words()
            sets = [shingles(t, size, known) for t in batch.column(2).to_pylist()]
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["at", "doc_id", "n", "digest", "sig"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("at", "doc_id", "text").mapInArrow(run, f"at long, doc_id {kind}, n long, digest binary, sig binary")


def _keys(reps: DataFrame) -> DataFrame:
    """(key, m): a row for each key of each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                keys, m = keys_of(sigs), part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(m, keys.shape[1]))], ["key", "m"])

    return reps.select("m", "sig").mapInArrow(run, "key long, m long")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols in which each signature of a differs from each of b."""
    return (a[:, None, :] != b[None, :, :]).sum(2)


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _mark_near(edges: DataFrame, limit: int) -> DataFrame:
    """Edges (x, p, sig, sig_p) -> (x, p, sig, near)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_signatures(batch.column(2)) != _signatures(batch.column(3))).sum(1) <= limit
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(near)], ["x", "p", "sig", "near"])

    return edges.select("x", "p", "sig", "sig_p").mapInArrow(run, "x long, p long, sig binary, near boolean")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether percent of the union or more is shared, in whole numbers."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _joined(pairs, sets, group, percent: int, far=()) -> np.ndarray:
    """For each row the number of its set, once the links among pairs (i, j), nearest first, have joined what ``group`` keeps apart.

    ``far`` has more pairs as (i, array of j); their links are few, so many of one row are counted in one pass.
    """
    group = list(group)

    def top(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i, j in pairs:
        a, b = top(i), top(j)
        if a != b and linked(sets[i], sets[j], percent):
            group[b] = a
    numbers = starts = None
    sizes = np.array([len(s) for s in sets], np.int64)
    for i, js in far:
        small, large = np.minimum(sizes[js], sizes[i]), np.maximum(sizes[js], sizes[i])
        mine = top(i)
        js = [j for j in js[100 * small >= percent * large].tolist() if top(j) != mine]
        if len(js) >= 32:
            if numbers is None:
                numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
                starts = np.cumsum(sizes) - sizes
                marked = np.zeros(int(numbers.max()) + 1, np.int64)
            own = numbers[starts[i] : starts[i] + sizes[i]]
            marked[own] = 1
            shared = np.add.reduceat(marked[numbers], starts)[js]
            marked[own] = 0
            js = [j for j, n in zip(js, shared.tolist()) if 100 * n >= percent * (sizes[i] + sizes[j] - n)]
        for j in js:
            a, b = top(i), top(j)
            if a != b and linked(sets[i], sets[j], percent):
                group[b] = a
    return np.array([top(i) for i in range(len(group))], np.int64)


def _against(left: np.ndarray, right: np.ndarray, limit: int, step: int = 64):
    """Pairs (i, j) up to THRESHOLD, nearest first, and those beyond it up to the limit as (i, array of j), without the whole cube of comparisons."""
    found, far = [], []
    for at in range(0, len(left), step):
        d = _distances(left[at : at + step], right)
        i, j = np.nonzero(d <= THRESHOLD)
        found.append(np.stack([d[i, j], i + at, j]))
        more = (d > THRESHOLD) & (d <= limit)
        far.extend((i + at, np.flatnonzero(more[i]).astype(np.int32)) for i in np.flatnonzero(more.any(1)).tolist())
    all_found = np.concatenate(found, 1)
    return all_found[1:, np.argsort(all_found[0], kind="stable")].T.tolist(), far


def _paired(members: DataFrame, size: int = BLOCK) -> DataFrame:
    """Split groups p into bounded groups (p, i, j): block i of the rows with ``left`` against block j of all rows.

    Rows get a ``side``: 0 in their block i, 1 in their block j. Groups without left rows go.
    """
    counts = members.groupBy("p").agg(F.ceil(F.count("*") / size).cast("int").alias("nj"), F.ceil(F.count_if("left") / size).cast("int").alias("ni")).where("ni > 0")
    rows = members.join(counts, "p").withColumn("h", F.xxhash64("x"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    i, j = F.pmod("h", F.col("ni")).cast("int"), F.pmod("h", F.col("nj")).cast("int")
    one = rows.where("left").withColumns({"side": F.lit(0), "i": i}).withColumn("j", numbers("nj"))
    two = rows.withColumns({"side": F.lit(1), "j": j}).withColumn("i", numbers("ni"))
    return one.unionByName(two).drop("h", "ni", "nj")


def numbered(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows as a written table (at, doc_id, text), ``at`` being a row's place in the input.

    The place depends on how the input is split, which may change between reads, so it is taken once.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("at"), F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return written(rows, "numbered")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 2, percent: int = 80, bits: int = 26, block: int = BLOCK, at: str | None = None) -> DataFrame:
    """at, doc_id, n_shingles, class_at, component_id of every row.

    Words are separated by ASCII white space, A-Z in lower case; the set of a text holds its
    runs of ``size`` words. Rows are linked if their sets share ``percent`` of the union;
    class_at is the first place in reach (that row stands for its class), component_id the
    smallest key.

    1. Rows with equal sets become one representative (the first row).
    2. Every key of the multi-index has its smallest representative as pivot, found by a minimum
       with map-side combine; a candidate is an edge (x, pivot). Whatever shares a key shares a
       pivot, so the group of a pivot holds all candidate pairs without their being listed.
    3. A member stays in a group if some member's signature is within a limit: the pivot's, or,
       for members far from the pivot, another one's, compared block by block. A link exceeds
       the limit with a chance of at most MISS.
    4. Each member is compared in the group of its first pivot, in blocks, on the full sets, and
       found links are joined into components.
    5. Groups that still hold several components are compared exactly: the members outside the
       group's largest component against all. A pair that shares a key and is within the limit
       is thus either in one component or confirmed not to be a link.

    No step lists the pairs of a group, and no task holds more than two blocks (``block`` rows) of one. Nulls and
    texts without words have the empty set and are linked with nothing; null keys are passed
    over for component_id unless a class has no other; repeated keys are separate rows; a text
    of any length is one set; an empty table gives an empty result; other columns are ignored.
    Rows are numbered once, in a written table; ``at`` names a column of a written table that
    numbers them already.
    """
    spark, limit = docs.sparkSession, farthest(percent)
    if at is None:
        rows = numbered(docs, key, text)
    else:
        rows = docs.select(F.col(at).alias("at"), F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    sets = stored(_sets(rows, size))
    by_set = sets.where(F.col("digest").isNotNull()).groupBy("digest")
    reps = stored(by_set.agg(F.min("at").alias("m"), F.min("doc_id").alias("low"), F.first("sig").alias("sig")))
    keys = _keys(reps)
    pivots = keys.groupBy("key").agg(F.min("m").alias("p"), F.count("*").alias("n")).where("n > 1").select("key", "p")
    edges = keys.join(pivots, "key").where("m <> p").select(F.col("m").alias("x"), "p").distinct()
    signed = reps.select("m", "sig")
    edges = edges.join(signed.select(F.col("m").alias("x"), "sig"), "x").join(signed.select(F.col("m").alias("p"), F.col("sig").alias("sig_p")), "p")
    edges = stored(_mark_near(edges, limit))
    groups = edges.groupBy("p").agg(F.count("*").alias("n"), F.count_if(~F.col("near")).alias("far")).where("n > 1 AND far > 0").select("p")

    def met(group: pa.Table) -> Iterator[pa.RecordBatch]:
        side, x, sig = group["side"].to_numpy(), group["x"].to_numpy(), _signatures(group["sig"])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        hit = np.zeros(len(left), bool)
        for at in range(0, len(left), 64):
            part = left[at : at + 64]
            hit[at : at + 64] = ((_distances(sig[part], sig[right]) <= limit) & (x[part][:, None] != x[right][None, :])).any(1)
        found = x[left[hit]]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), group["p"][0].as_py())), pa.array(found)], ["p", "x"])

    doubtful = edges.join(groups, "p", "left_semi").select("p", "x", "sig", (~F.col("near")).alias("left"))
    partners = in_groups(_paired(doubtful, block), ["p", "i", "j"], met, "p long, x long")
    members = stored(edges.where("near").select("p", "x").unionByName(partners).distinct())
    members = members.unionByName(members.select("p", F.col("p").alias("x")).distinct())
    wanted = members.select("x").distinct()
    bitmap = spark.sparkContext.broadcast(bitmap_of(wanted.select(F.xxhash64("x").alias("h")), bits))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = in_bitmap(bitmap.value, batch.column(2).to_numpy().view(np.uint64), bits)
            for part in slices(iter([batch.filter(pa.array(hit))])):
                known = worker_words()
                found = [shingles(t, size, known) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([signature(s).tobytes() if len(s) else None for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())],
                    ["x", "sig", "values"],
                )

    whole = rows.select("at", "text", F.xxhash64("at").alias("h")).mapInArrow(full, "x long, sig binary, values binary").join(wanted, "x", "left_semi")
    whole = stored(whole)

    def compare(group: pa.Table) -> Iterator[pa.RecordBatch]:
        x, sig = group["x"].to_numpy(), _signatures(group["sig"])
        values = [np.frombuffer(v, np.uint64) for v in group["values"].to_pylist()]
        if "side" in group.schema.names:
            side, component = group["side"].to_numpy(), group["component"].to_numpy()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            near, far = _against(sig[left], sig[right], limit)
            pairs, far = [(left[i], right[j]) for i, j in near], [(left[i], right[js]) for i, js in far]
            first = {c: i for i, c in reversed(list(enumerate(component.tolist())))}
            start = [first[c] for c in component.tolist()]
        else:
            near, far = _against(sig, sig, limit)
            pairs, far, start = [(i, j) for i, j in near if i < j], [(i, js[js > i]) for i, js in far], range(len(x))
        # every member of a joined set beside its smallest one: stars need few rounds to become components
        top = _joined(pairs, values, start, percent, far)
        number = group["component"].to_numpy() if "side" in group.schema.names else x
        low = np.full(len(x), np.iinfo(np.int64).max)
        np.minimum.at(low, top, number)
        pairs = np.unique(np.stack([low[top], number], 1)[low[top] != number], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    home = members.where("x <> p").groupBy("x").agg(F.min("p").alias("p"))
    blocks = home.groupBy("p").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    placed = home.join(blocks, "p").select("p", "x", F.pmod(F.xxhash64("x"), F.col("nb")).cast("int").alias("b"))
    placed = placed.unionByName(blocks.select("p", F.col("p").alias("x"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b")))
    links = stored(in_groups(placed.join(whole, "x"), ["p", "b"], compare, "a long, b long"))
    nodes = members.select(F.col("x").alias("id")).distinct()
    known = stored(components(nodes, links))
    grouped = members.join(known.select(F.col("id").alias("x"), "component"), "x")
    parts = grouped.groupBy("p", "component").count()
    largest = parts.groupBy("p").agg(F.max_by("component", F.struct("count", "component")).alias("largest"), F.count("*").alias("parts")).where("parts > 1")
    mixed = grouped.join(largest, "p").select("p", "x", "component", (F.col("component") != F.col("largest")).alias("left"))
    more = in_groups(_paired(mixed, block).join(whole, "x"), ["p", "i", "j"], compare, "a long, b long")
    between = stored(more.distinct())  # of components, not of members
    whole_classes = components(between.select(F.col("a").alias("id")).union(between.select("b")).distinct(), between)
    final = known.join(whole_classes.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left")
    final = final.select("id", F.coalesce("root", "component").alias("component"))
    classes = reps.select("digest", "m", "low").join(final.select(F.col("id").alias("m"), "component"), "m", "left")
    classes = classes.select("digest", "low", F.coalesce("component", "m").alias("class_at"))
    lows = classes.groupBy("class_at").agg(F.min("low").alias("component_id"))
    classes = classes.join(lows, "class_at").select("digest", "class_at", "component_id")
    joined = sets.join(classes, "digest", "left")
    alone = F.col("digest").isNull()
    return joined.select(
        "at",
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("at")).otherwise(F.col("class_at")).alias("class_at"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
  ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM t),
u AS (SELECT min(doc_id) AS r, g, len(g) AS n FROM (SELECT doc_id, list_sort(g) AS g FROM s WHERE len(g) > 0) GROUP BY g),
x AS (SELECT r, n, hash(unnest(g)) AS h FROM u),
f AS (SELECT h, count(*) AS df FROM x GROUP BY h),
o AS (SELECT r, n, x.h, row_number() OVER (PARTITION BY r ORDER BY df, x.h) AS k FROM x JOIN f USING (h)),
p AS (SELECT r, n, h FROM o WHERE k <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT a.r AS a, b.r AS b FROM p a JOIN p b ON a.h = b.h AND a.r < b.r AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
l AS (SELECT a, b FROM c JOIN u ua ON ua.r = a JOIN u ub ON ub.r = b
  WHERE 100 * len(list_intersect(ua.g, ub.g)) >= 80 * (ua.n + ub.n - len(list_intersect(ua.g, ub.g)))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
v AS (WITH RECURSIVE reach(id, c) AS (SELECT r, r FROM u UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.id WHERE reach.c < e.b)
  SELECT id, min(c) AS c FROM reach GROUP BY id),
m AS (SELECT s.doc_id, len(s.g) AS n, CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE v.c END AS c
  FROM s LEFT JOIN u ON u.g = list_sort(s.g) LEFT JOIN v ON v.id = u.r)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM m
"""


@query("op5_hamming", _SQL)
def op5_hamming(spark, folder):
    """Near-duplicate classes of all documents on two-word shingles."""
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
