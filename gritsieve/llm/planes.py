"""Token ids in binary files of byte planes, written and read in document order.

A file holds the ids of consecutive documents in blocks of a fixed number of ids. A block's ids
are transposed into four byte planes (the first bytes of all ids, then the second ones ...),
each compressed with zstandard, so the nearly empty upper planes cost almost nothing. After the
blocks stands the chunk index: place, plane lengths, number of ids and checksum of each block,
and the ids and token counts of the documents, also as planes.

    magic | block* | index (JSON, zstandard) | document planes | lengths of both (2 x u8) | magic
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gritsieve.llm.chunks import ChunkIds
from gritsieve.llm.common import open_folder, query, shared_folder, slices, stored, table, worker_cache
from gritsieve.llm.segment_bpe import byte_signs

MAGIC = b"IDPLANE1"
BLOCK = 1 << 18
MANIFEST = "_manifest.json"


def to_planes(values: np.ndarray) -> list[bytes]:
    """The bytes of little-endian numbers, plane by plane, compressed."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    rows = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return [squeeze(np.ascontiguousarray(rows[:, i])) for i in range(values.itemsize)]


def from_planes(planes: list[bytes], count: int, kind: str) -> np.ndarray:
    out = np.empty((count, len(planes)), np.uint8)
    for i, plane in enumerate(planes):
        out[:, i] = np.frombuffer(zstandard.ZstdDecompressor().decompress(plane, max_output_size=max(1, count)), np.uint8)
    return out.reshape(-1).view(kind)


class PlaneWriter:
    """Appends documents; holds at most one block and the document index."""

    def __init__(self, stream, block: int = BLOCK):
        self.stream, self.block = stream, block
        stream.write(MAGIC)
        self.place = len(MAGIC)
        self.pending: list[np.ndarray] = []
        self.n_pending = self.n_tokens = 0
        self.blocks, self.keys, self.counts = [], [], []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.counts.append(len(ids))
        self.n_tokens += len(ids)
        while len(ids):
            part, ids = ids[: self.block - self.n_pending], ids[self.block - self.n_pending :]
            self.pending.append(part)
            self.n_pending += len(part)
            if self.n_pending == self.block:
                self._cut()

    def _put(self, planes: list[bytes]) -> list[int]:
        for plane in planes:
            self.stream.write(plane)
        self.place += sum(map(len, planes))
        return [len(p) for p in planes]

    def _cut(self) -> None:
        if self.n_pending:
            ids = np.concatenate(self.pending).astype("<u4")
            start = self.place
            lengths = self._put(to_planes(ids))
            self.blocks.append([start, len(ids), zlib.crc32(ids.tobytes()), lengths])
            self.pending, self.n_pending = [], 0

    def close(self) -> None:
        self._cut()
        keys = to_planes(np.array([0 if k is None else k for k in self.keys], "<i8"))
        counts = to_planes(np.array(self.counts, "<u8"))
        index = {
            "blocks": self.blocks,
            "n_docs": len(self.keys),
            "null_keys": [i for i, k in enumerate(self.keys) if k is None],
            "keys": [len(p) for p in keys],
            "counts": [len(p) for p in counts],
        }
        packed, documents = zstandard.ZstdCompressor().compress(json.dumps(index).encode()), b"".join(keys + counts)
        self.stream.write(packed + documents + struct.pack("<QQ", len(packed), len(documents)) + MAGIC)


def read_file(handle, size: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(key, ids) of each document of a random-access file, block by block."""
    tail = handle.read_at(16 + len(MAGIC), size - 16 - len(MAGIC))
    n_index, n_documents = struct.unpack("<QQ", tail[:16])
    if tail[16:] != MAGIC:
        raise ValueError("not a file of id planes")
    raw = handle.read_at(n_index + n_documents, size - len(tail) - n_index - n_documents)
    index = json.loads(zstandard.ZstdDecompressor().decompress(raw[:n_index]))

    def cut(data: bytes, lengths: list[int]) -> list[bytes]:
        ends = np.cumsum(lengths).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    documents = cut(raw[n_index:], index["keys"] + index["counts"])
    keys = from_planes(documents[:8], index["n_docs"], "<i8").tolist()
    for i in index["null_keys"]:
        keys[i] = None
    held, blocks = np.empty(0, "<u4"), iter(index["blocks"])
    for key, count in zip(keys, from_planes(documents[8:], index["n_docs"], "<u8").tolist()):
        parts = [held]
        while sum(map(len, parts)) < count:
            start, n, crc, lengths = next(blocks)
            ids = from_planes(cut(handle.read_at(sum(lengths), start), lengths), n, "<u4")
            if zlib.crc32(ids.tobytes()) != crc:
                raise ValueError(f"block at {start} is damaged")
            parts.append(ids)
        held = np.concatenate(parts) if len(parts) > 1 else held
        yield key, held[:count]
        held = held[count:]


def library_chunks(path: str) -> ChunkIds:
    """Chunks encoded with the tokenizers library; one per worker."""
    return worker_cache(("library", path), lambda: _library_chunks(path))


def _library_chunks(path: str) -> ChunkIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    model, signs = tokenizer.model, str.maketrans(dict(enumerate(byte_signs())))
    plain = model.end_of_word_suffix is not None

    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def whole(texts: list[str]) -> list[bytes]:
        return [pack(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    tails = dict(zip(".,", whole([".", ","])))

    def encode(texts: list[str]) -> list[bytes]:
        """A run of lower-case Latin letters, which normalising and splitting leave as it is, goes straight to the library's model."""
        out: list[bytes] = [b""] * len(texts)
        others = []
        for i, t in enumerate(texts):
            tail = tails.get(t[-1])
            head = t if tail is None else t[:-1]
            if plain and head.isalpha() and (head.isascii() or max(head) < "\u0250") and head == head.lower():
                signed = head if head.isascii() else head.encode().decode("latin-1").translate(signs)
                ids = pack([token.id for token in model.tokenize(signed)])
                out[i] = ids if tail is None else ids + tail
            else:
                others.append(i)
        for at in range(0, len(others), 2000):
            part = others[at : at + 2000]
            for i, ids in zip(part, whole([texts[i] for i in part])):
                out[i] = ids
        return out

    return ChunkIds(encode, cased=(b"<|",))


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text", parts: int | None = None, block: int = BLOCK) -> str:
    """Encode whole texts and write them under ``folder`` in ascending key order; returns the folder.

    Rows are range-partitioned by key and, for equal keys, by their place in the input, so no
    key can fill a task. Each task streams its sorted rows into one file under a temporary name
    and renames it when complete; a repeated task writes the same bytes. The manifest, renamed
    last, lists the files in order with the number of ids before each: it commits the folder.

    Null and empty texts have the end id alone; repeated rows are written each; a null key sorts
    first and is kept; texts longer than a block span blocks; an empty table gives a manifest
    without files; other columns are ignored. ``docs`` must be a repeatable read.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = open_folder(folder)
        part = TaskContext.get().partitionId()
        name, temporary = f"part-{part:06d}.ids", f"{path}/_{part:06d}-{uuid.uuid4().hex}"
        chunks, writer, stream = library_chunks(tokenizer), None, None
        for batch in slices(batches):
            if writer is None:
                filesystem.create_dir(path, recursive=True)
                stream = filesystem.open_output_stream(temporary)
                writer = PlaneWriter(stream, block)
            for k, ids in zip(batch.column(0).to_pylist(), chunks.of_texts(batch.column(1).to_pylist())):
                writer.add(k, np.frombuffer(ids + end, "<u4"))
        if writer is not None:
            writer.close()
            stream.close()
            filesystem.move(temporary, f"{path}/{name}")
            yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "n_docs": len(writer.keys), "n_tokens": writer.n_tokens}])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).withColumn("at", F.monotonically_increasing_id())
    sorted_rows = rows.repartitionByRange(parts, "key", "at").sortWithinPartitions("key", "at").select("key", "text")
    files = stored(sorted_rows.mapInArrow(run, "part long, file string, n_docs long, n_tokens long")).orderBy("part").collect()
    start, entries = 0, []
    for f in files:  # one entry per written file
        entries.append({"file": f["file"], "n_docs": f["n_docs"], "n_tokens": f["n_tokens"], "start": start})
        start += f["n_tokens"]
    filesystem, path = open_folder(folder)
    filesystem.create_dir(path, recursive=True)
    temporary = f"{path}/_manifest-{uuid.uuid4().hex}"
    with filesystem.open_output_stream(temporary) as stream:
        stream.write(json.dumps({"format": MAGIC.decode(), "n_tokens": start, "files": entries}).encode())
    filesystem.move(temporary, f"{path}/{MANIFEST}")
    return folder


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a written folder; one task per file."""
    filesystem, path = open_folder(folder)
    with filesystem.open_input_stream(f"{path}/{MANIFEST}") as stream:
        entries = json.loads(stream.read())["files"]
    sent = spark.sparkContext.broadcast(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = open_folder(folder)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                entry = sent.value[i]
                name, start, rows, size = f"{path}/{entry['file']}", entry["start"], [], 0
                with filesystem.open_input_file(name) as handle:
                    for key, ids in read_file(handle, handle.size()):
                        rows.append((key, start, len(ids), ids.tobytes()))
                        start += len(ids)
                        size += 4 * len(ids)
                        if size > 4 << 20:
                            yield _rows(rows)
                            rows, size = [], 0
                if rows:
                    yield _rows(rows)

    return spark.range(0, len(entries), 1, max(1, len(entries))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "start", "n_tokens", "ids"])


@query("op2_id_planes")
def op2_id_planes(spark, folder):
    """Write all documents' ids, read the files back, and digest what they hold."""
    written = write_ids(table(spark, folder, "documents"), shared_folder(spark, "ids"), public_tokenizers.path("word_bpe_49k.json"))
    return read_ids(spark, written).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
