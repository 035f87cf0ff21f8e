"""Shards of near-equal bytes from indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

from heapq import heapify, heapreplace, heappop

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gritsieve.llm.common import query, stored, table


def karmarkar_karp(sizes: list[int], shards: int) -> list[int]:
    """A shard for each item: the largest differencing method for any number of shards.

    Every item starts as a partial partition with itself in one part. The two partial
    partitions of largest spread are joined, the largest part of one with the smallest of the
    other and so on, until one is left; it is then unrolled from the last join to the items.
    """
    if not sizes:
        return []
    # a partial partition: its sums from large to small, lowered so that the last is zero
    heap = [(-size, i, (size,) + (0,) * (shards - 1)) for i, size in enumerate(sizes)]
    heapify(heap)
    joins: list[tuple[int, int, list[int]]] = []
    while len(heap) > 1:
        _, a, sums_a = heappop(heap)
        _, b, sums_b = heap[0]
        sums = [x + y for x, y in zip(sums_a, reversed(sums_b))]
        order = sorted(range(shards), key=sums.__getitem__, reverse=True)
        low = sums[order[-1]]
        made = tuple(sums[i] - low for i in order)
        heapreplace(heap, (-made[0], len(sizes) + len(joins), made))
        joins.append((a, b, order))
    places = {heap[0][1]: list(range(shards))}  # part of a partial partition -> shard
    for number in range(len(joins) - 1, -1, -1):
        a, b, order = joins[number]
        shard_of = places.pop(len(sizes) + number)
        own = [0] * shards
        for part, i in enumerate(order):
            own[i] = shard_of[part]
        places[a], places[b] = own, own[::-1]
    return [places[i][0] for i in range(len(sizes))]


def balanced_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", fineness: int = 1024) -> DataFrame:
    """Put each row into a shard so that equal texts stay together and bytes are near equal.

    Groups of equal texts (by two checksums and the length, so distinct texts that agree in all
    three would merely share a shard) are summed with map-side combine. Groups above
    1 / (shards * fineness) of all bytes are items of their own, at most shards * fineness; all
    lighter groups fall by hash into as many bundles. These items, bounded by the two
    parameters and never by the table, are differenced on the driver; rows meet their item's
    shard by broadcast. A group larger than a shard's fair share gets a shard that holds little
    else, which is the best that indivisible groups allow.

    Slots count the rows of a shard from 0 without gaps: rows fall by hash into about
    sqrt(rows) blocks per shard, blocks are summed, and only rows of one block are ever sorted
    together, so a shard or a text with a third of all rows is no single task.

    A null text counts as empty; empty texts are one group; repeated rows are separate rows of
    one group; an empty table gives an empty result; other columns are ignored. The rows are
    checkpointed once with their place in the input, which tells equal rows apart.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = stored(
        docs.select(
            F.col(key).alias("doc_id"),
            (F.octet_length(value) + 1).cast("long").alias("size"),
            F.crc32(value.cast("binary")).alias("text_crc32"),
            F.xxhash64(value).alias("h"),
            F.monotonically_increasing_id().alias("at"),
        )
    )
    group = ["h", "text_crc32", "size"]
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n_items = shards * fineness
    groups = stored(rows.groupBy(*group).agg(F.count("*").alias("n")).withColumn("bytes", F.col("n") * F.col("size")))
    heavy = F.col("bytes") * n_items > F.lit(total)
    bundle = F.pmod(F.xxhash64("h", "text_crc32"), F.lit(n_items)).cast("int").alias("bundle")
    large = groups.where(heavy).select(*group, "bytes").orderBy(*group).collect()  # fewer than n_items
    small = groups.where(~heavy).groupBy(bundle).agg(F.sum("bytes").alias("bytes")).orderBy("bundle").collect()  # n_items at most
    shard_of = karmarkar_karp([r["bytes"] for r in large + small], shards)
    spark = docs.sparkSession
    own = spark.createDataFrame([(r["h"], r["text_crc32"], r["size"], s) for r, s in zip(large, shard_of)], "h long, text_crc32 long, size long, own int")
    shared = spark.createDataFrame([(r["bundle"], s) for r, s in zip(small, shard_of[len(large) :])], "bundle int, shared int")
    placed = (
        rows.withColumn("bundle", bundle)
        .join(F.broadcast(own), group, "left")
        .join(F.broadcast(shared), "bundle", "left")
        .withColumn("shard", F.coalesce("own", "shared"))
    )
    blocks = max(1, int(n_rows**0.5))
    placed = placed.select("doc_id", "size", "text_crc32", "shard", "at", F.pmod(F.xxhash64("doc_id", "at"), F.lit(blocks)).alias("block"))
    counts = placed.groupBy("shard", "block").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("block")) - F.col("count")
    starts = counts.select("shard", "block", before.alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "at")) - 1
    return placed.withColumn("inside", inside).join(starts, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("inside")).alias("slot")
    )


@query("op1_balance")
def op1_balance(spark, folder):
    """Sixteen shards of all documents; texts are indivisible and bytes near equal."""
    return balanced_shards(table(spark, folder, "documents"), 16).withColumn("grown_shard", F.lit(None).cast("int"))
