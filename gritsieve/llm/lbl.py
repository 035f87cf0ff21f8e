"""Log-bilinear language model trained by noise-contrastive estimation, scoring whole texts.

Frequent words are classes of their own; all other words share classes by their last two
bytes. A context of two classes is mapped by one matrix per position to a vector, whose
products with the class vectors, plus biases, are the scores of the next class. A word's
probability is its class's times the smoothed share of its count in the class, with one share
left for all unseen words of the class, so that the probabilities of all words sum to one.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.common import crc_mod, query, slices, stored, table

END = b""  # no word is empty
BUCKETS = 256
OWN = 768
WIDTH = 16
BATCH = 2048
NOISE = 64
LOG10 = np.log(10.0)
MARKS = b".,;:!?"


def words_of(text: str | None) -> list[bytes]:
    """The words with A-Z in lower case, and the end."""
    words = (text or "").encode().lower().split()
    words.append(END)
    return words


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - 2**63


def bucket_of(word: bytes) -> int:
    """The class of a word that has none of its own: its last two bytes and whether a mark follows them."""
    bare = word.rstrip(MARKS)
    return zlib.crc32(bare[-2:] + b"." * (len(bare) < len(word))) % BUCKETS


def word_counts(texts: DataFrame, flush: int = 400_000) -> DataFrame:
    """(w, bucket, c): how often each word, by its 64-bit hash, occurs in a column ``text``; pre-summed in the tasks."""
    fields = ["w", "bucket", "c"]

    def rows(counter: Counter) -> Iterator[pa.RecordBatch]:
        words = list(counter)
        for at in range(0, len(words), 100_000):
            part = words[at : at + 100_000]
            columns = (
                pa.array(map(word_hash, part), pa.int64(), size=len(part)),
                pa.array(map(bucket_of, part), pa.int32(), size=len(part)),
                pa.array(map(counter.__getitem__, part), pa.int64(), size=len(part)),
            )
            yield pa.RecordBatch.from_arrays(list(columns), fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                counter.update(words_of(text))
            if len(counter) > flush:
                yield from rows(counter)
                counter = Counter()
        yield from rows(counter)

    counts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "w long, bucket int, c long")
    return counts.groupBy("w").agg(F.first("bucket").alias("bucket"), F.sum("c").alias("c"))


class Lexicon:
    """Classes and counts of the frequent words; fixed size whatever the corpus."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, own: int):
        order = np.lexsort((hashes, -counts))
        hashes, counts = hashes[order], counts[order]
        end = word_hash(END)
        owners = [end, *[h for h in hashes[: own + 1].tolist() if h != end][: own - 1]]
        self.hashes, self.counts = hashes, counts
        self.class_of = {h: BUCKETS + i for i, h in enumerate(owners)}
        self.n_classes = BUCKETS + len(owners)


class WordCodes(dict):
    """Word -> code, with class, hash, log10(count + 1) and whether it is frequent for each code."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.log_counts = lexicon, dict(zip(lexicon.hashes.tolist(), np.log10(lexicon.counts + 1.0).tolist()))
        self.kind, self.hash, self.log_count, self.common = array("H"), array("q"), array("d"), array("b")

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self.kind)
        h = word_hash(word)
        log_count = self.log_counts.get(h)
        self.kind.append(self.lexicon.class_of.get(h) or bucket_of(word))
        self.hash.append(h)
        self.log_count.append(log_count or 0.0)
        self.common.append(log_count is not None)
        return code

    def forget(self) -> None:
        self.clear()
        self.kind, self.hash, self.log_count, self.common = array("H"), array("q"), array("d"), array("b")


def encoded(rows: DataFrame, lexicon) -> DataFrame:
    """Rows (at, doc_id, held_out, text) -> classes of the tokens, sums over frequent words, and the rare words' hashes."""
    schema = f"at long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_common long, log_all double, log_shared double, kinds binary, rare array<long>"
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes(lexicon.value)
        for batch in slices(batches):
            if len(codes) > 800_000:
                codes.forget()
            words = [words_of(t) for t in batch.column(3).to_pylist()]
            flat = np.fromiter((codes[w] for ws in words for w in ws), np.int64)
            if not len(flat):
                continue
            n = np.array([len(ws) for ws in words])
            first = np.cumsum(n) - n
            kinds = np.array(codes.kind, np.uint16)[flat]
            common, logs = np.array(codes.common, np.int8)[flat], np.array(codes.log_count)[flat]
            rare_at = np.flatnonzero(common == 0)
            rare = np.array(codes.hash, np.int64)[flat[rare_at]]
            ends = np.concatenate([[0], np.searchsorted(rare_at, first + n)]).astype(np.int32)
            data, cuts = kinds.tobytes(), (2 * first).tolist()
            columns = [
                batch.column(0),
                batch.column(1),
                batch.column(2),
                pa.array(n),
                pa.array(np.add.reduceat(common.astype(np.int64), first)),
                pa.array(np.add.reduceat(logs, first)),
                pa.array(np.add.reduceat(np.where(kinds < BUCKETS, logs, 0.0), first)),
                pa.array([data[a : a + 2 * m] for a, m in zip(cuts, n.tolist())], pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(rare)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select("at", "doc_id", "held_out", "text").mapInArrow(run, schema)


def contexts(kinds: list[bytes], begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's class, the class before it and the one before that; ``begin`` stands before a text."""
    w = np.frombuffer(b"".join(kinds), np.uint16).astype(np.int64)
    n = np.array([len(k) // 2 for k in kinds])
    first = (np.cumsum(n) - n)[n > 0]
    c1 = np.concatenate([[begin], w[:-1]])[: len(w)]
    c1[first] = begin
    c2 = np.concatenate([[begin], c1[:-1]])[: len(w)]
    c2[first] = begin
    return w, c1, c2


class LogBilinear:
    """Parameters: context vectors, a matrix per context position, class vectors and biases."""

    def __init__(self, class_counts: np.ndarray, seed: int = 11):
        rng, m = np.random.default_rng(seed), len(class_counts)
        self.noise = (class_counts + 1.0) / (class_counts.sum() + m)
        self.q = rng.normal(0, 0.1, (m + 1, WIDTH)).astype(np.float32)
        self.c = np.stack([np.eye(WIDTH, dtype=np.float32), 0.5 * np.eye(WIDTH, dtype=np.float32)])
        self.p = rng.normal(0, 0.1, (m, WIDTH)).astype(np.float32)
        self.b = np.log(self.noise).astype(np.float32)  # before training: the unigram model of classes

    def values(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.q, self.c, self.p, self.b)]).astype(np.float64)

    def set(self, values: np.ndarray) -> None:
        for name in ("q", "c", "p", "b"):
            x = getattr(self, name)
            setattr(self, name, values[: x.size].astype(np.float32).reshape(x.shape))
            values = values[x.size :]

    def logits(self, first: int) -> np.ndarray:
        """Scores of all classes after each second-last class, the last one being ``first``."""
        return (self.q[first] @ self.c[0] + self.q @ self.c[1]) @ self.p.T + self.b

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """What the last and the second-last class add to the score of each class."""
        return (self.q @ self.c[0]) @ self.p.T, (self.q @ self.c[1]) @ self.p.T


def _scatter(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    sorted_rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
    return sorted_rows[first], np.add.reduceat(values[order], first, axis=0)


class NoiseContrastive:
    """Steps of noise-contrastive estimation with Adagrad: tell a token from NOISE draws of the class unigram."""

    def __init__(self, model: LogBilinear, seed: int, rate: float = 0.1):
        self.m, self.rng, self.rate = model, np.random.default_rng(seed), rate
        self.squares = {k: np.full(getattr(model, k).shape, 0.05, np.float32) for k in ("q", "c", "p", "b")}
        self.cumulative = np.cumsum(model.noise)
        self.offset = np.log(NOISE * model.noise).astype(np.float32)

    def _step(self, name: str, grad: np.ndarray, rows=slice(None)) -> None:
        self.squares[name][rows] += grad * grad
        getattr(self.m, name)[rows] -= self.rate * grad / np.sqrt(self.squares[name][rows])

    def batch(self, w: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> None:
        m, n = self.m, len(w)
        drawn = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), len(m.noise) - 1)
        q1, q2 = m.q[c1], m.q[c2]
        r = q1 @ m.c[0] + q2 @ m.c[1]
        pw, pn = m.p[w], m.p[drawn]
        true = 1 / (1 + np.exp(np.clip((r * pw).sum(1) + m.b[w] - self.offset[w], -30, 30)))  # 1 - sigmoid
        false = 1 / (1 + np.exp(-np.clip(r @ pn.T + (m.b[drawn] - self.offset[drawn]), -30, 30)))
        true, false = -true / n, false / n
        back = true[:, None] * pw + false @ pn
        scale = np.float32(64)  # gradients are means over a batch; Adagrad wants them near one
        for name, rows, grad in (
            ("p", np.concatenate([w, drawn]), np.concatenate([true[:, None] * r, false.T @ r])),
            ("b", np.concatenate([w, drawn]), np.concatenate([true, false.sum(0)])),
            ("q", np.concatenate([c1, c2]), np.concatenate([back @ m.c[0].T, back @ m.c[1].T])),
        ):
            at, total = _scatter(rows, grad)
            self._step(name, scale * total, at)
        self._step("c", scale * np.stack([q1.T @ back, q2.T @ back]))


def training_runs(texts: DataFrame, lanes: int, rounds: int, most: int = 64) -> DataFrame:
    """(turn, lane, h, kinds, n_times): the texts dealt to rounds and lanes by their content alone.

    Equal texts are counted before the shuffle and dealt in runs of at most ``most``, so that copies of one text
    fill no lane.
    """
    counted = texts.groupBy("kinds").agg(F.count("*").alias("n"))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / most).cast("long"))))
    h = F.xxhash64("kinds", "run")
    return runs.select(
        F.pmod(h, F.lit(rounds)).cast("int").alias("turn"),
        F.pmod(F.shiftrightunsigned(h, 16), F.lit(lanes)).cast("int").alias("lane"),
        h.alias("h"),
        "kinds",
        F.least(F.lit(most), F.col("n") - most * F.col("run")).cast("long").alias("n_times"),
    )


def pieces_of(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(lane, texts) pieces of about ``limit`` bytes; how the batches are cut makes no difference."""
    lane, held, size = -1, [], 0
    for batch in batches:
        columns = (batch.column(batch.schema.names.index(c)) for c in ("lane", "kinds", "n_times"))
        for at, kinds, n in zip(*(c.to_pylist() for c in columns)):
            if held and (at != lane or size + len(kinds) * n > limit):
                yield lane, held
                held, size = [], 0
            lane = at
            held += [kinds] * n
            size += len(kinds) * n
    if held:
        yield lane, held


FINE = 2.0**32  # of logarithms summed as whole numbers, whose order makes no difference
SCALE = 2.0**16  # of the parameters' sums


def train(texts: DataFrame, model: LogBilinear, n_tokens: int, rounds: int = 4, merge: int = 16) -> LogBilinear:
    """Fit the model on the column ``kinds`` of all rows, ``n_tokens`` tokens in all.

    Each round takes another part of the texts by a hash of their content. Its lanes, whose number grows with the
    root of the tokens, run through their texts in the order of the hash from the common parameters and with a seed
    of their own; the results are averaged by their numbers of tokens: first within ``merge`` groups of lanes, whose
    sums are all that reaches the driver. The sums are of whole numbers, so their order makes no difference: neither
    the split of the input nor the number of tasks changes the model.
    """
    spark, begin = texts.sparkSession, len(model.noise)
    lanes = max(1, math.ceil(math.sqrt(n_tokens / rounds) / 128))
    runs = stored(training_runs(texts, lanes, rounds))
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            lane, learner, n_seen = -1, None, 0

            def result() -> pa.RecordBatch:
                sums = np.rint(learner.m.values() * SCALE).astype(np.int64) * n_seen
                return pa.RecordBatch.from_pylist([{"part": lane % merge, "n": n_seen, "params": sums.tobytes()}])

            for at, kinds in pieces_of(batches):
                if at != lane:
                    if n_seen:
                        yield result()
                    own = LogBilinear.__new__(LogBilinear)
                    own.__dict__.update({k: v.copy() for k, v in sent.value.__dict__.items()})
                    lane, learner, n_seen = at, NoiseContrastive(own, 1_000_003 * turn + at), 0
                w, c1, c2 = contexts(kinds, begin)
                order = learner.rng.permutation(len(w))
                for i in range(0, len(order), BATCH):
                    chosen = order[i : i + BATCH]
                    learner.batch(w[chosen], c1[chosen], c2[chosen])
                n_seen += len(w)
            if n_seen:
                yield result()

        def add(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total, part = 0, 0, 0
            for batch in group:
                for part, k, params in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "params"))):
                    n, total = n + k, total + np.frombuffer(params, np.int64)
            yield pa.RecordBatch.from_pylist([{"part": part, "n": n, "params": total.tobytes()}])

        mine = runs.where(F.col("turn") == turn).repartitionById(lanes, "lane").sortWithinPartitions("lane", "h", "kinds", "n_times")
        sums = mine.select("lane", "kinds", "n_times").mapInArrow(run, "part long, n long, params binary")
        parts = sums.groupBy("part").applyInArrow(add, "part long, n long, params binary").collect()
        if parts:
            parts.sort(key=lambda p: p["part"])
            total = sum(np.frombuffer(p["params"], np.int64).astype(np.float64) for p in parts)
            model.set(total / SCALE / sum(p["n"] for p in parts))
        sent.unpersist()
    return model


def log_normalisers(spark, model: LogBilinear) -> np.ndarray:
    """log Z of every context, from matrix products of all contexts with all classes, in tasks by last class."""
    n, sent = len(model.q), spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column(0).to_pylist():
                logits = sent.value.logits(first)
                top = logits.max(1)
                z = top + np.log(np.exp(logits - top[:, None]).sum(1))
                yield pa.RecordBatch.from_pylist([{"first": first, "z": z.astype(np.float32).tobytes()}])

    rows = spark.range(0, n, 1, 32).mapInArrow(run, "first long, z binary").collect()  # one per class
    table = np.zeros((n, n), np.float32)
    for r in rows:
        table[r["first"]] = np.frombuffer(r["z"], np.float32)
    return table


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", fold: int = 7, held: int = 2, common: int = 1 << 19, own: int = OWN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    Word counts, classes and the model come from all documents outside the held-out fold.
    At most ``common`` frequent words and ``own`` classes travel to the tasks as tables; all
    other words are counted and looked up by a shuffle join on their hash, which no frequent
    word can skew.

    All figures follow from the texts and keys alone, however the input is split.

    A null or empty text is its end alone; repeated rows and keys are scored each; a null key
    is in no fold and trains; with nothing to learn from, every count is 0 and classes are
    equally likely; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumns(
        {"at": F.monotonically_increasing_id(), "held_out": F.coalesce(crc_mod(F.col("doc_id"), fold) == held, F.lit(False))}
    )
    counts = stored(word_counts(rows.where(~F.col("held_out"))))
    level = F.floor(8 * F.log2("c")).cast("int").alias("level")
    levels = counts.groupBy(level).agg(F.count("*").alias("words"), F.sum("c").alias("c")).orderBy(F.desc("level")).collect()  # 8 per doubling
    n_train, n_words = sum(r["c"] for r in levels), sum(r["words"] for r in levels)
    least, taken = 1 << 30, 0
    for r in levels:
        taken += r["words"]
        if taken > common:
            break
        least = r["level"]
    head = counts.where(level >= least).select("w", "c").toArrow()  # at most ``common`` rows
    lexicon = Lexicon(head["w"].to_numpy(), head["c"].to_numpy(), own)
    own_counts = dict(zip(head["w"].to_numpy().tolist(), head["c"].to_numpy().tolist()))
    owners = spark.createDataFrame([(h,) for h in lexicon.class_of], "w long")  # at most ``own`` rows
    shared = counts.join(F.broadcast(owners), "w", "left_anti")
    class_counts, class_words = np.zeros(lexicon.n_classes), np.zeros(lexicon.n_classes)
    for r in shared.groupBy("bucket").agg(F.sum("c").alias("c"), F.count("*").alias("words")).collect():  # one per bucket
        class_counts[r["bucket"]], class_words[r["bucket"]] = r["c"], r["words"]
    for h, k in lexicon.class_of.items():
        class_counts[k] = own_counts.get(h, 0)
    within = np.log10(class_counts + class_words + 1.0)
    within[BUCKETS:] = 0.0  # a class of one word
    texts = stored(encoded(rows, spark.sparkContext.broadcast(lexicon)))
    rare = texts.select("at", F.explode("rare").alias("w")).join(counts.select("w", "c"), "w")
    rare = rare.groupBy("at").agg((F.sum(F.rint(F.log10(F.col("c") + 1.0) * FINE).cast("long")) / FINE).alias("rare_log"), F.count("*").alias("rare_known"))
    model = train(texts.where(~F.col("held_out")), LogBilinear(class_counts), n_train or 0)
    last, second = model.products()
    tables = spark.sparkContext.broadcast((last, second, model.b, log_normalisers(spark, model), within))
    begin = lexicon.n_classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, second, bias, norm, within = tables.value
        for batch in slices(batches, "kinds", 1 << 20):
            kinds = batch.column(1).to_pylist()
            w, c1, c2 = contexts(kinds, begin)
            logs = (last[c1, w] + second[c2, w] + bias[w] - norm[c1, c2]).astype(np.float64) / LOG10 - within[w]
            n = np.array([len(k) // 2 for k in kinds])
            sums = np.add.reduceat(logs, np.cumsum(n) - n) if len(n) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums)], ["at", "model"])

    scored = texts.select("at", "kinds").mapInArrow(run, "at long, model double")
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = texts.drop("kinds", "rare").join(scored, "at").join(rare, "at", "left")
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + zero(F.col("rare_known"))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("log_all") + zero(F.col("rare_log")) - F.col("n_tokens") * float(np.log10(n_train + n_words + 1.0))).alias("base_score"),
        (F.col("model") + F.col("log_shared") + zero(F.col("rare_log"))).alias("score"),
    )


@query("op6_log_bilinear")
def op6_log_bilinear(spark, folder):
    """Log-probabilities of all documents."""
    return score_texts(table(spark, folder, "documents"))
