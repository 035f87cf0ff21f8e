"""Toxic passages as maximal scoring segments of token log-odds.

Log-odds with Dirichlet priors are learnt from labelled documents; a linear-time scan finds
every maximal scoring segment of a text; a segment's score becomes an expected number of chance
segments by the extreme-value law, and a text's significant segments become its probability.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from gritsieve.llm.common import crc_mod, query, slices, stored, table, worker_cache, written

TOKEN = re.compile(r"[^\W\d_]+")
FOLDS, HELD = 4, 2  # documents with crc32(key) mod FOLDS = HELD are held out
BINS = 64  # of the evidence, for calibration
PREFIXES = (7, 6, 5, 4)  # lengths of word beginnings that may bear a gain of their own


def lowered(text: str) -> str:
    """Lower case with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in zip(text, map(str.lower, text)))


def segments(gains: Iterator[tuple[int, float, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) from (place, running total before, after) of each gain.

    One pass: a gain looks back to the nearest candidate that began at a lower running total. If
    that one also ended lower, both and all between become one candidate, which looks back again;
    else the gain stays a candidate. Every candidate keeps the place its look ended, so looks
    never walk a stretch twice.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # first, last, total before, total after, where its look ended
    for place, before, after in gains:
        first, j = place, len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= after:
                break
            first, _, before, _, back = kept[j]
            del kept[j:]
            j = back
        kept.append((first, place, before, after, j))
    return [(a, b, high - low) for a, b, low, high, _ in kept]


def features(word: str) -> list[str]:
    """A word and its beginnings, which bear a star, the most specific first."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


class Gains(dict):
    """What each word adds, 0 for most: the gain of its most specific feature that has one; remembers words it met."""

    def __init__(self, known: dict[str, float], limit: int = 500_000):
        super().__init__()
        self.known, self.limit = known, limit

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        gain = self[word] = next((self.known[f] for f in features(word) if f in self.known), 0.0)
        return gain


@dataclass
class ToxicModel:
    """Gains of the words and beginnings that speak for the label, the loss of any other word, and the calibration."""

    gains: dict[str, float] = field(default_factory=dict)
    loss: float = 1.0
    decay: float = 1.0  # of the extreme-value law
    size: float = 1.0  # its search-space constant
    base: float = 0.0
    slope: float = 0.0

    def digest(self) -> str:
        return hashlib.sha1(repr((sorted(self.gains.items()), self.loss, self.decay, self.size, self.base, self.slope)).encode()).hexdigest()

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and the maximal segments as word places."""
        words = TOKEN.findall(lowered(text))
        gains = self.__dict__.get("_met") or self.__dict__.setdefault("_met", Gains(self.gains))

        def moves() -> Iterator[tuple[int, float, float]]:
            total, last = 0.0, 0
            for i, gain in [(i, g) for i, g in enumerate(map(gains.__getitem__, words)) if g]:
                total -= self.loss * (i - last)
                yield i, total, total + gain
                total, last = total + gain, i + 1

        return len(words), segments(moves())

    def expected(self, score: float, n: int) -> float:
        """Chance segments of at least this score among n words of unmarked text."""
        return self.size * n * math.exp(-self.decay * score)

    def evidence(self, n: int, scores: list[float]) -> float:
        """Sum over the significant segments, those expected less than once, of how far they are beyond chance."""
        return sum(max(0.0, -math.log(max(self.expected(s, n), 1e-300))) for s in scores)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.base + self.slope * min(evidence, BINS)))))


def decay_of(chances: np.ndarray, scores: np.ndarray) -> float:
    """The positive root x of sum(chance * exp(x * score)) = 1; the mean score must be negative and some score positive."""
    excess = lambda x: float((chances * np.exp(np.minimum(700, x * scores))).sum()) - 1
    low, high = 0.0, 1.0
    while excess(high) <= 0 and high < 400:
        low, high = high, high * 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) <= 0 else (low, mid)
    return (low + high) / 2


def logistic(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Base and slope (0 or more) of the label's log-odds by Newton steps on weighted points."""
    design = np.stack([np.ones_like(x), x], 1)
    weights, n = np.zeros(2), positive + negative
    weights[0] = math.log((positive.sum() + 0.5) / (negative.sum() + 0.5))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (positive - n * p) - ridge * weights
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(curve, slope)
        weights += step * min(1.0, 4 / max(1e-12, float(np.abs(step).max())))
    return float(weights[0]), max(0.0, float(weights[1]))


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label_key: str, label: str, sample: int) -> DataFrame:
    """(text, y, part) of about ``sample`` labelled documents outside the held-out fold; part 0 calibrates, the others teach.

    The labels are drawn by a hash of their key, so they are few enough to travel and no text is shuffled.
    """
    marks = labels.select(F.col(label_key).alias("k"), F.col(label).cast("int").alias("y")).where("k IS NOT NULL AND y IN (0, 1)")
    marks = marks.where(crc_mod(F.col("k"), FOLDS) != HELD).groupBy("k").agg(F.max("y").alias("y"))
    share = (1 << 30) * sample // max(1, marks.count())
    marks = marks.where(F.pmod(F.xxhash64("k", F.lit("label")), F.lit(1 << 30)) < share)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(marks), "k").select("text", "y", F.pmod(F.xxhash64("text"), F.lit(4)).alias("part"))


def _feature_counts(rows: DataFrame) -> DataFrame:
    """(word, d1, d0, y1, y0): texts of each label with a feature, and its occurrences; the empty word has the sums over words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, places = (Counter(), Counter()), (Counter(), Counter())
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                words = Counter(TOKEN.findall(lowered(text)))
                found: Counter = Counter()
                for w, n in words.items():
                    for f in features(w):
                        found[f] += n
                texts[y].update(found.keys())
                texts[y][""] += len(words)
                found[""] = words.total()
                places[y].update(found)
            names = sorted(texts[0].keys() | texts[1].keys())
            counts = [texts[1], texts[0], places[1], places[0]]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[w] for w in names], pa.int64()) for c in counts)], ["word", "d1", "d0", "y1", "y0"])

    names = ["d1", "d0", "y1", "y0"]
    return rows.mapInArrow(run, "word string, d1 long, d0 long, y1 long, y0 long").groupBy("word").agg(*[F.sum(c).alias(c) for c in names])


def _gain_counts(rows: DataFrame, gains: dict[str, float]) -> dict[float, int]:
    """How often unmarked texts hold words of each gain."""
    sent = rows.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found = Gains(sent.value), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(map(known.__getitem__, TOKEN.findall(lowered(text))))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.float64()), pa.array(list(found.values()), pa.int64())], ["gain", "n"])

    counts = rows.where("y = 0").select("text").mapInArrow(run, "gain double, n long").groupBy("gain").agg(F.sum("n").alias("n"))
    return {r["gain"]: r["n"] for r in counts.collect()}


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label_key: str = "doc_id",
    label: str = "toxic",
    prior: float = 0.02,
    least_z: float = 5.0,
    loss: float = 0.25,
    vocabulary: int = 65_536,
    sample: int = 40_000,
) -> ToxicModel:
    """A model of about ``sample`` labelled documents outside the held-out fold, drawn by hash; all of them, if they are fewer.

    Words and word beginnings are judged alike, by occurrences: each label's prior counts are
    ``prior`` times those of both together. A feature that speaks for the label is kept if
    the root of its log-likelihood ratio, by texts, is ``least_z``, so one text that repeats a
    word proves nothing; the ``vocabulary`` surest at most, which bounds what reaches the driver and the tasks. Any other
    word costs ``loss``, so a passage ends where such words are too many. Three quarters of the
    texts, by hash, give the log-odds, one quarter the law's constant and the calibration.

    A document counts as marked if any of its labels is 1; labels that are null, neither 0 nor
    1, or without a document are left out. Without labels of both kinds every score is the
    share of marked documents, 0 where there are none.
    """
    rows = written(labelled(docs, labels, key, text, label_key, label, sample), "labelled")
    teaching = rows.where("part <> 0")
    counts = stored(_feature_counts(teaching))
    total = counts.where("word = ''").first()
    kinds = rows.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("y1"), F.count(F.lit(1)).alias("n")).first()
    model = ToxicModel(base=math.log(max(kinds["y1"], 1e-12) / max(kinds["n"] - kinds["y1"], 1e-12)) if kinds["n"] else -700.0)
    if total is None or not total["y1"] or not total["y0"]:
        return model

    def odds(y: str, n: str) -> str:
        """Log-odds of a feature in a label's words under the Dirichlet prior; a is its prior count."""
        size = total[n] + prior * (total["y1"] + total["y0"])
        return f"ln(({y} + a) / ({float(size)!r}D - {y} - a))"

    def surprise(d: str, n: str) -> str:
        """A label's part of the log-likelihood ratio against a feature that both labels' texts share alike."""
        share = total[n] / (total["d1"] + total["d0"])
        return f"if({d} > 0, {d} * ln({d} / ((d1 + d0) * {share!r}D)), 0D)"

    words = counts.where("word <> ''").selectExpr("*", f"(y1 + y0) * {prior!r}D AS a")
    words = words.selectExpr("word", f"round({odds('y1', 'y1')} - {odds('y0', 'y0')}, 2) AS gain", f"sqrt(2 * greatest(0D, {surprise('d1', 'd1')} + {surprise('d0', 'd0')})) AS z")
    kept = words.where((F.col("gain") > 0) & (F.col("z") >= least_z)).orderBy(F.desc("z"), "word").limit(vocabulary).collect()
    if not kept:
        return model
    model.gains, model.loss = {r["word"]: r["gain"] for r in kept}, loss
    seen = {g: 0.5 for g in model.gains.values()}  # a gain that unmarked texts never show is rare, not impossible
    for g, n in _gain_counts(teaching, model.gains).items():
        seen[g] = seen.get(g, 0.0) + n
    gains = np.array(sorted(seen))
    chances = np.array([seen[g] for g in gains.tolist()])
    model.decay = decay_of(chances / chances.sum(), np.where(gains > 0, gains, -loss))
    return _calibrated(model, rows.where("part = 0"))


def _calibrated(model: ToxicModel, rows: DataFrame) -> ToxicModel:
    """Fits the law's constant on unmarked texts, then the log-odds of the label on the evidence of all."""
    scanned = stored(_scans(rows, model))
    law = scanned.where("y = 0 AND n > 0").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("n") * F.exp(-F.lit(model.decay) * F.col("best"))).alias("space")).first()
    if law["texts"]:
        model.size = law["texts"] / max(law["space"], 1e-300)
    gain = f"{model.decay!r}D * s - ln({model.size!r}D * n)"
    evidence = F.expr(f"aggregate(scores, 0D, (sum, s) -> sum + greatest(0D, {gain}))")
    bins = scanned.groupBy(F.least(F.floor(F.coalesce(evidence, F.lit(0.0)) * 2), F.lit(2 * BINS)).alias("bin"), "y").agg(F.count(F.lit(1)).alias("n")).collect()
    if {r["y"] for r in bins} == {0, 1}:
        places = sorted({r["bin"] for r in bins})
        n = {(r["bin"], r["y"]): r["n"] for r in bins}
        model.base, model.slope = logistic(np.array(places) / 2.0, *(np.array([n.get((b, y), 0) for b in places], float) for y in (1, 0)))
    return model


def _scans(rows: DataFrame, model: ToxicModel) -> DataFrame:
    """(y, n, best, scores): each text's label, words, highest segment score and all segment scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scans = [model.scan(t) for t in batch.column("text").to_pylist()]
            scores = [[s for _, _, s in found] for _, found in scans]
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), pa.array([n for n, _ in scans], pa.int64()), pa.array([max(s, default=0.0) for s in scores], pa.float64()), pa.array(scores, pa.list_(pa.float64()))],
                ["y", "n", "best", "scores"],
            )

    return rows.mapInArrow(run, "y int, n long, best double, scores array<double>")


PASSAGE = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType()), StructField("expected", DoubleType())])


def toxicity(docs: DataFrame, model: ToxicModel, text: str = "text", names: tuple[str, str] = ("score", "passages")) -> DataFrame:
    """The rows with the probability of the label and every significant passage of the whole text.

    A passage is (start, end, score, expected): characters from start to end, its log-odds, and
    how many such passages chance would give in a text of this length; those below one are
    listed, in order. Null and empty texts and texts without words have no passage and the score
    of such a text; a text of any length is one scan; equal texts get equal results; an empty
    table stays empty. Other columns are kept, but for those that bear one of ``names``.
    """
    rows = docs.drop(*names)
    at = rows.columns.index(text)
    schema = StructType([*rows.schema.fields, StructField(names[0], DoubleType()), StructField(names[1], ArrayType(PASSAGE))])
    sent, name = docs.sparkSession.sparkContext.broadcast(model), model.digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_cache(("toxicity", name), lambda: sent.value)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
        for batch in slices(batches, text):
            odds, passages = [], []
            for t in batch.column(at).to_pylist():
                n, found = known.scan(t or "")
                odds.append(known.probability(known.evidence(n, [s for _, _, s in found])))
                sure = [(a, b, s, known.expected(s, n)) for a, b, s in found]
                sure = [p for p in sure if p[3] < 1]
                places = [m.span() for m in TOKEN.finditer(lowered(t))] if sure else []
                passages.append([{"start": places[a][0], "end": places[b][1], "score": s, "expected": e} for a, b, s, e in sure])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odds, pa.float64()), pa.array(passages, kind)], [*batch.schema.names, *names])

    return rows.mapInArrow(run, schema)


LEAST = 0.3  # a score from which a text counts as toxic


@query("op12_toxic_segments")
def op12_toxic_segments(spark, folder):
    """Toxicity of all documents, learnt outside the held-out quarter."""
    docs = table(spark, folder, "documents")
    rows = docs.select("doc_id", "text", F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"))
    told = toxicity(rows, train(docs, table(spark, folder, "labels")))
    predicted = F.when(F.col("score") >= LEAST, 1).otherwise(0)
    return told.select("doc_id", "held_out", "score", predicted.alias("predicted"), F.size("passages").alias("n_passages"))
