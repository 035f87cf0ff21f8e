"""Helpers the operators of this folder share: checkpoints, shared folders, batches, components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from functools import reduce, wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritsieve.session import ensure_checkpoint_dir

ROOT = str(Path(__file__).resolve().parents[2])
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its check."""

    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            find_package(spark)
            return f(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this package even if the driver was started in another folder."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows go to the folder in spark.checkpoint.dir, which outlives executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet in a shared folder: whatever is numbered or drawn in them is the same in every later read."""
    folder = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI (file, hdfs, s3, gs), for use inside tasks."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace(":", "://", 1))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the values of ``column`` in a piece stay near ``limit`` bytes."""
    for batch in batches:
        values = batch.column(batch.schema.names.index(column))
        step = max(1, int(limit * len(batch) / max(1, values.nbytes)))
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


_CACHE: dict[object, object] = {}


def worker_cache(name: object, make: Callable[[], object]):
    """What an operator keeps in a Python worker from task to task; another operator's is let go."""
    if name not in _CACHE:
        _CACHE.clear()
        _CACHE[name] = make()
    return _CACHE[name]


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32(key as text) mod a number: the fold of a row."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over the undirected edges (a, b); every vertex has a row.

    Hooking with pointer jumping: each round every root takes the smallest label among its
    neighbours' labels and labels are replaced by their labels' labels. Rounds grow with the
    logarithm of the longest chain; each is joins and minima with map-side combine, so a
    vertex with very many edges is no single task's load. Only counters reach the driver.
    """
    both = stored(
        edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    )
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("far")), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("far").alias("far"))
        )
        own = labels.join(near, "id").select("id", "component", F.least("component", "far").alias("low"))
        # the root of each label hears of the smallest label any of its members met
        roots = own.groupBy(F.col("component").alias("id")).agg(F.min("low").alias("root"))
        met = own.join(roots, "id", "left").select("id", "component", F.least("low", "root").alias("low"))
        jumps = met.select(F.col("id").alias("low"), F.col("low").alias("next"))
        new = stored(met.join(jumps, "low", "left").select("id", "component", F.least("low", "next").alias("new")))
        changed = new.where("new <> component").limit(1).count()
        labels = new.select("id", F.col("new").alias("component"))
        if not changed:
            break
    return vertices.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def bitmap_of(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bit ``h >>> (64 - bits)`` set for each value of the long column ``h``: 2**bits bits whatever the table's size."""
    place = F.shiftrightunsigned("h", 64 - bits)
    masks = (
        hashes.select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(F.lit(63)).alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit AS INT))")).alias("mask"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[masks["word"].to_numpy()] = masks["mask"].to_numpy().view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which unsigned hashes may be among those of the bitmap; none of them is missed."""
    bit = hashes >> np.uint64(64 - bits)
    return ((bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)


def in_groups(df: DataFrame, keys: list[str], f: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``f`` to the rows of each key; groups must be bounded, as f holds one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            columns = [batch.column(batch.schema.names.index(k)).to_numpy(zero_copy_only=False) for k in keys]
            new = np.zeros(len(batch), bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            first = tuple(c[0] for c in columns)
            new[0] = last is not None and first != last
            last = tuple(c[-1] for c in columns)
            at = 0
            for cut in np.flatnonzero(new).tolist():
                if cut > at:
                    held.append(batch.slice(at, cut - at))
                yield from f(pa.Table.from_batches(held))
                held, at = [], cut
            held.append(batch.slice(at))
        if held:
            yield from f(pa.Table.from_batches(held))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
