"""Language identification by a byte convolutional network trained in numpy.

Filters of several widths slide over fixed windows of bytes, each filter's largest response in
a window is kept, and a softmax layer turns the responses into languages.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gritsieve.llm.common import crc_mod, query, slices, table, worker_cache

UNKNOWN = "und"
FOLDED = bytes(48 if 48 <= b <= 57 else b for b in range(256))  # all digits alike
ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return text is not None and (ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def windows_of(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the whole texts as rows of bytes, blanks at a text's end, and how many each text has."""
    rows = [t.encode().lower().translate(FOLDED) for t in texts]
    counts = np.array([max(1, -(-len(r) // length)) for r in rows], np.int64)
    joined = b"".join(r.ljust(n * length) for r, n in zip(rows, counts.tolist()))
    return np.frombuffer(joined, np.uint8).reshape(-1, length), counts


@dataclass
class ByteCNN:
    """Weights by filter width: (width, 256, filters); then a dense layer over all filters."""

    languages: list[str]
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    length: int = 256
    seed: int = 7
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        for w in self.widths:
            self.weights[f"w{w}"] = rng.normal(0, 0.3, (w, 256, self.filters)).astype(np.float32)
        n = len(self.widths) * self.filters
        self.weights["bias"] = np.zeros(n, np.float32)
        self.weights["out"] = rng.normal(0, 0.3, (n, len(self.languages))).astype(np.float32)
        self.weights["out_bias"] = np.zeros(len(self.languages), np.float32)

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of every filter in every window, and where it was."""
        best, where = [], []
        for w in self.widths:
            kernel, span = self.weights[f"w{w}"], windows.shape[1] - w + 1
            out = sum(kernel[j][windows[:, j : j + span]] for j in range(w))
            at = out.argmax(1)
            where.append(at)
            best.append(np.take_along_axis(out, at[:, None], 1)[:, 0])
        return np.concatenate(best, 1) + self.weights["bias"], np.concatenate(where, 1)

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.01) -> "ByteCNN":
        """Adam on the mean cross-entropy; all randomness comes from the seed."""
        rng, step = np.random.default_rng(self.seed), 0
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                x, y = windows[chosen], labels[chosen]
                raw, where = self.responses(x)
                pooled = np.maximum(raw, 0)
                logits = pooled @ self.weights["out"] + self.weights["out_bias"]
                slope = np.exp(logits - logits.max(1, keepdims=True))
                slope /= slope.sum(1, keepdims=True)
                slope[np.arange(len(y)), y] -= 1
                slope /= len(y)
                back = (slope @ self.weights["out"].T) * (raw > 0)
                grads = {"out": pooled.T @ slope, "out_bias": slope.sum(0), "bias": back.sum(0)}
                for n, w in enumerate(self.widths):
                    part = slice(n * self.filters, (n + 1) * self.filters)
                    grad = np.zeros_like(self.weights[f"w{w}"])
                    for j in range(w):  # a filter learns from the bytes under its largest response
                        bytes_there = np.take_along_axis(x, where[:, part] + j, 1)
                        np.add.at(grad[j], (bytes_there, np.broadcast_to(np.arange(self.filters), bytes_there.shape)), back[:, part])
                    grads[f"w{w}"] = grad
                step += 1
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    scale = rate / (1 - 0.9**step)
                    self.weights[k] -= scale * first[k] / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
        return self

    def digest(self) -> str:
        """Tells networks apart."""
        return hashlib.sha1(b"".join(self.weights[k].tobytes() for k in sorted(self.weights))).hexdigest()

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The filters as sums of two rows: one for a pair of bytes, one for the pair two bytes on."""
        near, far = [], []
        for w in self.widths:
            k = self.weights[f"w{w}"]
            none = np.zeros((256, self.filters), np.float32)
            pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, self.filters)
            near.append(pair(k[0], k[1] if w > 1 else none))
            far.append(pair(k[2] if w > 2 else none, k[3] if w > 3 else none))
        return np.concatenate(near, 1), np.concatenate(far, 1)


class Predictor:
    """Applies a trained network to windows in batches; a window's last positions, where a filter would leave it, do not count."""

    def __init__(self, model: ByteCNN, rows: int = 64):
        if max(model.widths) > 4:
            raise ValueError("filters of at most 4 bytes")
        self.model, self.rows = model, rows
        self.near, self.far = model.tables()

    def logits(self, windows: np.ndarray) -> np.ndarray:
        m, out = self.model, []
        for at in range(0, len(windows), self.rows):
            x = windows[at : at + self.rows].astype(np.int64)
            pairs = (x[:, :-1] << 8) | x[:, 1:]
            sums = self.near.take(pairs[:, :-2], 0)
            sums += self.far.take(pairs[:, 2:], 0)
            out.append(np.maximum(sums.max(1) + m.weights["bias"], 0) @ m.weights["out"] + m.weights["out_bias"])
        return np.concatenate(out) if out else np.zeros((0, len(m.languages)), np.float32)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Language number and score of whole texts: mean logits of the windows by their bytes."""
        windows, counts = windows_of(texts, self.model.length)
        logits = self.logits(windows).astype(np.float64)
        first = np.cumsum(counts) - counts
        weight = np.full(len(windows), float(self.model.length))
        sizes = np.array([len(t.encode()) for t in texts])
        weight[first + counts - 1] = np.maximum(1, sizes - (counts - 1) * self.model.length)
        mean = np.add.reduceat(logits * weight[:, None], first, 0) / np.add.reduceat(weight, first)[:, None]
        odds = np.exp(mean - mean.max(1, keepdims=True))
        odds /= odds.sum(1, keepdims=True)
        best = odds.argmax(1)
        return best, odds[np.arange(len(best)), best]


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 500, per_text: int = 4, fold: int = 5) -> ByteCNN | None:
    """A network fitted on about ``per_language`` labelled texts of each language.

    Documents whose crc32(key) mod ``fold`` is 0 are held out. The sample is chosen by a hash
    of the key against a share that follows from the counts of all labelled rows; of each text
    up to ``per_text`` windows, spread over the whole text, go to the driver, so what is
    collected is bounded by the two parameters and the number of languages. Returns None where
    nothing is labelled.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where(
        (crc_mod(F.col("k"), fold) != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    bits = 1 << 30
    share = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(bits, per_language * bits // n + 1))])
    chosen = rows.where(F.pmod(F.xxhash64("k", F.lit("sample")), F.lit(bits)) < share[F.col("lang")])
    length = ByteCNN([]).length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if not len(batch):
                continue
            windows, ends = windows_of(batch.column(1).to_pylist(), length)
            out, first = [], np.cumsum(ends) - ends
            for lang, at, n in zip(batch.column(2).to_pylist(), first.tolist(), ends.tolist()):
                places = np.unique(np.linspace(0, n - 1, min(n, per_text)).astype(int))
                out += [{"lang": lang, "window": windows[at + p].tobytes()} for p in places]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("lang", pa.string()), ("window", pa.binary())]))

    sample = sorted((r["lang"], bytes(r["window"])) for r in chosen.mapInArrow(run, "lang string, window binary").collect())
    languages = sorted({lang for lang, _ in sample})
    number = {lang: i for i, lang in enumerate(languages)}
    windows = np.frombuffer(b"".join(w for _, w in sample), np.uint8).reshape(-1, length)
    return ByteCNN(languages).fit(windows, np.array([number[lang] for lang, _ in sample]))



def predict(docs: DataFrame, model: ByteCNN | None, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows with a language and a score for each whole text, row by row.

    Null texts and texts without a letter get ``und`` and 0, as all do without a model; a text
    of any length is a run of windows; repeated rows and ties give equal results (the earlier
    language wins); an empty table stays empty. All other columns are kept, except columns that
    already bear one of ``names``, which are replaced.
    """
    rows = docs.drop(*names)
    at = rows.columns.index(text)
    schema = StructType([*rows.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = worker_cache(("languages", model.digest()), lambda: Predictor(model)) if model else None
        for batch in slices(batches, text):
            texts = batch.column(at).to_pylist()
            lettered = [i for i, t in enumerate(texts) if has_letter(t)] if predictor else []
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if lettered:
                best, odds = predictor.texts([texts[i] for i in lettered])
                scores[lettered] = odds
                for i, b in zip(lettered, best.tolist()):
                    langs[i] = model.languages[b]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], [*batch.schema.names, *names])

    return rows.mapInArrow(run, schema)


@query("op3_byte_cnn")
def op3_byte_cnn(spark, folder):
    """Predicted language of all documents, learnt outside the held-out fifth; a row without a key is in neither."""
    docs = table(spark, folder, "documents")
    rows = docs.select("doc_id", "text", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"))
    return predict(rows, train(docs)).select("doc_id", "held_out", "lang_pred", "score")
