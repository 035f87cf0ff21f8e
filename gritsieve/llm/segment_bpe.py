"""Byte-pair encoding by segment trees over the ranks of adjacent pairs, and its decoding.

A word's adjacent pairs are the leaves of a tree of minima keyed by (rank, position); the root
is the leftmost merge of lowest rank. A merge changes three leaves, so it costs a logarithm of
the word's length; merging ends when the root holds no mergeable pair. Words of like length
share one set of arrays and take their merges side by side.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.chunks import ChunkIds
from gritsieve.llm.common import query, slices, table, worker_cache

VOCABULARY = "word_bpe_49k.json"
NONE = np.iinfo(np.int64).max
LONG = 128  # bytes of a word from which it has arrays of its own
# The vocabulary file's own splitting pattern, white space by its Unicode property.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.base = max(vocab.values()) + 1
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], NONE), np.append(order, 0)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.pair_rank = {key: rank for rank, key in enumerate((left * self.base + right).tolist())}
        signs = byte_signs()
        self.inner = np.array([vocab[s] for s in signs], np.int64)
        self.last = np.array([vocab[s + suffix] for s in signs], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [tokens.get(i, "").encode() for i in range(max(tokens) + 1)]
        self.chunks = ChunkIds(self.encode_texts, cased=(b"<|",), limit=200_000)

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs, and which pairs have one."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        return self.ranks[at], self.keys[at] == key

    def pre_tokens(self, text: str) -> list[str | int]:
        """Words as they are merged, and ids of special tokens, in order."""
        out: list[str | int] = []
        for part in self.splitter.split(text) if self.splitter and "<|" in text else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                # lower case sign by sign: no final sigma
                lowered = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out.extend(PRE_TOKENS.findall(lowered))
        return out

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        split = [self.pre_tokens(t) for t in texts]
        words = list({w for ws in split for w in ws if isinstance(w, str)})
        ids = dict(zip(words, merge_words([w.encode() for w in words], self)))
        return [b"".join(ids[w] if isinstance(w, str) else int(w).to_bytes(4, "little") for w in ws) for ws in split]

    def decode(self, ids: bytes) -> bytes:
        """The tokens with a blank between, as UTF-8; special tokens are kept."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def vocabulary(path: str) -> Vocabulary:
    """One per worker."""
    return worker_cache(("vocabulary", path), lambda: Vocabulary(path))


def merge_words(words: list[bytes], vocab: Vocabulary, cells: int = 1 << 20) -> list[bytes]:
    """The ids of each word (not empty), as bytes."""
    out: list[bytes] = [b""] * len(words)
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        width = 1 << max(1, int(sizes[order[at]] - 1).bit_length())
        if width > LONG:
            out[order[at]] = _merge_long(words[order[at]], vocab)
            at += 1
            continue
        end = min(int(np.searchsorted(sizes[order], width, "right")), at + max(1, cells // width))
        chosen = order[at:end]
        for i, ids in zip(chosen.tolist(), _merge_block([words[i] for i in chosen], sizes[chosen], width, vocab)):
            out[i] = ids
        at = end
    return out


def _merge_block(words: list[bytes], sizes: np.ndarray, width: int, vocab: Vocabulary) -> list[bytes]:
    """Words of at most ``width`` bytes, a power of two, side by side."""
    n = len(words)
    column = np.arange(width)
    symbol = np.zeros((n, width), np.int64)
    inside = column < sizes[:, None]
    symbol[inside] = vocab.inner[np.frombuffer(b"".join(words), np.uint8)]
    symbol[np.arange(n), sizes - 1] = vocab.last[[w[-1] for w in words]]
    after = np.where(column + 1 < sizes[:, None], column + 1, width)  # the next symbol's place; width: none
    before = np.broadcast_to(column - 1, (n, width)).copy()  # -1: none
    leaves = np.full((n, width), NONE, np.int64)
    paired = after < width
    rank, known = vocab.rank(symbol[paired], np.roll(symbol, -1, 1)[paired])
    leaves[paired] = np.where(known, rank * width + np.broadcast_to(column, (n, width))[paired], NONE)
    tree = [leaves]
    while tree[-1].shape[1] > 1:
        tree.append(np.minimum(tree[-1][:, ::2], tree[-1][:, 1::2]))

    def put(rows, places, values):
        """Set leaves and the minima above them."""
        tree[0][rows, places] = values
        for below, level in zip(tree, tree[1:]):
            places = places >> 1
            level[rows, places] = np.minimum(below[rows, 2 * places], below[rows, 2 * places + 1])

    def pair(rows, left, right):
        rank, known = vocab.rank(symbol[rows, left], symbol[rows, right])
        return np.where(known, rank * width + left, NONE)

    alive = inside.copy()
    rows = np.flatnonzero(tree[-1][:, 0] < NONE)
    while len(rows):
        rank, place = np.divmod(tree[-1][rows, 0], width)
        gone = after[rows, place]
        beyond = after[rows, gone]
        symbol[rows, place] = vocab.merged[rank]
        alive[rows, gone] = False
        after[rows, place] = beyond
        more = beyond < width
        before[rows[more], beyond[more]] = place[more]
        put(rows, gone, NONE)
        value = np.full(len(rows), NONE, np.int64)
        value[more] = pair(rows[more], place[more], beyond[more])
        put(rows, place, value)
        earlier = before[rows, place]
        has = earlier >= 0
        put(rows[has], earlier[has], pair(rows[has], earlier[has], place[has]))
        rows = rows[tree[-1][rows, 0] < NONE]
    ids = symbol[alive].astype("<u4").tobytes()
    ends = (np.cumsum(alive.sum(1)) * 4).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


def _merge_long(word: bytes, vocab: Vocabulary) -> bytes:
    """One word of any length, with plain lists in place of arrays."""
    n = len(word)
    width = 1 << (n - 1).bit_length()
    symbol = [*vocab.inner[np.frombuffer(word[:-1], np.uint8)].tolist(), int(vocab.last[word[-1]])]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank_of, base, none = vocab.pair_rank, vocab.base, int(NONE)

    def key(left: int, right: int) -> int:
        rank = rank_of.get(symbol[left] * base + symbol[right])
        return none if rank is None else rank * width + left

    tree = [none] * (2 * width)  # node i has the children 2i and 2i + 1
    tree[width : width + n - 1] = [key(i, i + 1) for i in range(n - 1)]
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(place: int, value: int) -> None:
        i = place + width
        tree[i] = value
        while i > 1:
            i >>= 1
            low = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == low:
                break
            tree[i] = low

    while tree[1] < none:
        rank, place = divmod(tree[1], width)
        gone = after[place]
        beyond = after[gone]
        symbol[place], symbol[gone], after[place] = int(vocab.merged[rank]), -1, beyond
        put(gone, none)
        if beyond < n:
            before[beyond] = place
        put(place, key(place, beyond) if beyond < n else none)
        if before[place] >= 0:
            put(before[place], key(before[place], place))
    return np.array([s for s in symbol if s >= 0], "<u4").tobytes()


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the whole text's ids as little-endian unsigned 32-bit integers.

    Row by row, nothing is shuffled. Null and empty texts have no ids; repeated rows stay
    repeated; a word of any length costs n log n; an empty table gives an empty result; columns
    besides the two named are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = vocabulary(path).chunks
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(chunks.of_texts(part.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): the text of ids, special tokens included; null ids stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = vocabulary(path).decode
        for part in slices(batches, "ids"):
            texts = [None if ids is None else decode(ids).decode() for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, text string")


def encode_and_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, text): the ids of every text and the text decoded from them, in one pass.

    As encode_documents and decode_documents one after the other, with one Python worker a task
    in place of two that each hold the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for part in slices(batches):
            ids = vocab.chunks.of_texts(part.column(1).to_pylist())
            texts = pa.array([vocab.decode(i) for i in ids], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), texts], ["doc_id", "ids", "text"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, text string")


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, number of ids, and the digests of the ids and of the text decoded from them."""
    return encode_and_decode(docs, path).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op8_segment_bpe")
def op8_segment_bpe(spark, folder):
    """Token counts and digests of all documents."""
    return token_digests(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))
