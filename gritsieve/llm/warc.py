"""Deterministic sharded WARC archives with revisit records, and their reader.

Records are range-sorted by id; a task writes its range into gzip files of one member per
record and begins a new file when the compressed size passes a limit. Headers, record ids and
digests are made anew from the rows, so a repeated run or task writes the same bytes. Files
appear under temporary names and are renamed when complete; the manifest, a table written last
by Spark's own committer, names the files that belong to the archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritsieve.llm.common import open_folder, query, shared_folder, slices, stored, table, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  # rows carry no capture time; a parameter of the writer
END = b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
FILES = pa.schema([(n, pa.string() if n == "file" else pa.int64()) for n in ("part", "roll", "file", "first_key", "n_records", "n_bytes")])
RECORD_FIELDS = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uri(page: int | None, url: str | None = None, payload: bytes = b"") -> str:
    """A record id that follows from the page id alone, or, without one, from url and payload."""
    name = b"page:%d" % page if page is not None else b"url:%s\n" % (url or "").encode() + payload
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(name).digest()[:16], version=5)}>"


def build_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    """One record, uncompressed; a revisit keeps the payload's digest and length without it."""
    head = HTTP % len(payload)
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_uri(page, url, payload)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(block)),
        ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
        ("X-Page-Id", page),
        ("X-Payload-Length", len(payload)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_uri(refers_to)), ("WARC-Refers-To-Target-URI", refers_url), ("X-Refers-To-Page-Id", refers_to)]
    # a line break in a value would end its field
    lines = [f"{k}: {' '.join(str(v).split())}" for k, v in fields if v is not None]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + 2 * END + block + 2 * END


def gzip_member(data: bytes, level: int) -> bytes:
    """A gzip member without time or name, so equal data gives equal bytes."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def parse_record(data: bytes) -> tuple:
    """A row of RECORD_FIELDS from a record; raises if a length or digest does not hold."""
    head, _, rest = data.partition(2 * END)
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != 2 * END or "sha1:" + base32_sha1(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"record {fields.get('WARC-Record-ID')} is damaged")
    kind, refers = fields["WARC-Type"], fields.get("X-Refers-To-Page-Id")
    payload = block.partition(2 * END)[2] if kind == "response" else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and base32_sha1(payload) != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    page, length = fields.get("X-Page-Id"), int(fields["X-Payload-Length"])
    number = lambda v: None if v is None else int(v)
    return number(page), fields.get("WARC-Target-URI"), kind, payload, length, digest, number(refers)


def read_members(stream, piece: int = 1 << 20) -> Iterator[bytes]:
    """The content of each gzip member of a stream."""
    inflate, parts = zlib.decompressobj(31), []
    data = stream.read(piece)
    while data:
        parts.append(inflate.decompress(data))
        data = inflate.unused_data
        if inflate.eof:
            yield b"".join(parts)
            inflate, parts = zlib.decompressobj(31), []
        data = data or stream.read(piece)


def revisits(pages: DataFrame, least: int = 0, heavy: int = 1000) -> DataFrame:
    """(key, at, refers_to, refers_url) of the rows whose payload another row has as response.

    The response of equal payloads of at least ``least`` bytes is the largest key. Digests of
    more than one in ``heavy`` rows (fewer than ``heavy`` of them) meet their rows by broadcast,
    all others by shuffle, so a payload that a third of the rows share fills no task.
    """
    rows = stored(pages.select("key", "at", "url", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")).where(F.col("size") >= least))
    total = rows.count()
    groups = stored(rows.groupBy("digest").agg(F.max("key").alias("refers_to"), F.max_by("url", "key").alias("refers_url"), F.count("*").alias("n")).where("n > 1"))
    hot = F.col("n") > max(1, total // heavy)
    found = []
    for chosen, hint in ((groups.where(hot), F.broadcast), (groups.where(~hot), lambda g: g)):
        found.append(rows.join(hint(chosen.drop("n")), "digest").where(~F.col("key").eqNullSafe(F.col("refers_to"))).select("key", "at", "refers_to", "refers_url"))
    return found[0].unionByName(found[1])


def write_warc(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0,
    roll: int = 64 << 20, parts: int | None = None, level: int = 6, date: str = DATE,
) -> str:
    """Write a record for each row under ``folder``; returns the folder.

    The html crosses the network once: the narrow rows that tell a revisit what it refers to
    are put through the same range exchange and stand right before the page they belong to.

    A null html has an empty payload; empty payloads are equal to each other when ``least`` is
    0; a null url leaves the field out; rows with an equal key stay separate records (of equal
    payloads, all rows with the largest key are responses); rows without a key stand first, without
    the page-id field, and are responses only if no equal payload has a key; an empty table writes a
    manifest without files; other columns are ignored. A row's place in ``pages`` tells equal rows
    apart; it is taken once, in a written table.
    """
    spark = pages.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(
        F.col(key).cast("long").alias("key"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("at", F.monotonically_increasing_id())
    rows = written(rows, "numbered")
    marks = revisits(rows, least).select("key", "at", F.lit(0).alias("kind"), F.col("refers_url").alias("url"), F.lit(None).cast("binary").alias("payload"), "refers_to")
    both = rows.select("key", "at", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("refers_to")).unionByName(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = open_folder(folder)
        part, files, mark = TaskContext.get().partitionId(), [], None
        stream = temporary = None

        def close() -> None:
            if stream is not None:
                stream.close()
                filesystem.move(temporary, f"{path}/{files[-1]['file']}")

        for batch in slices(batches, "payload"):
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    mark = row
                    continue
                of = mark if mark is not None and (mark["key"], mark["at"]) == (row["key"], row["at"]) else {"refers_to": None, "url": None}
                member = gzip_member(build_record(row["key"], row["url"], row["payload"], of["refers_to"], of["url"], date), level)
                if stream is None or files[-1]["n_bytes"] + len(member) > roll:
                    close()
                    filesystem.create_dir(path, recursive=True)
                    files.append({"part": part, "roll": len(files), "file": f"pages-{part:06d}-{len(files):05d}.warc.gz", "first_key": row["key"], "n_records": 0, "n_bytes": 0})
                    temporary = f"{path}/_{part:06d}-{uuid.uuid4().hex}"
                    stream = filesystem.open_output_stream(temporary, compression=None)
                stream.write(member)
                files[-1]["n_records"] += 1
                files[-1]["n_bytes"] += len(member)
        close()
        if files:
            yield pa.RecordBatch.from_pylist(files, schema=FILES)

    ordered = both.repartitionByRange(parts, "key", "at").sortWithinPartitions("key", "at", "kind")
    files = ordered.mapInArrow(run, "part long, roll long, file string, first_key long, n_records long, n_bytes long")
    stored(files).write.mode("overwrite").parquet(f"{folder}/manifest")
    return folder


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files the manifest names, every length and digest verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = open_folder(folder)
        names = [f.split() for f in RECORD_FIELDS.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), names)], [n for n, _ in names])

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with filesystem.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for member in read_members(stream):
                        rows.append(parse_record(member))
                        size += len(member)
                        if size > 4 << 20:
                            yield made(rows)
                            rows, size = [], 0
                if rows:
                    yield made(rows)

    manifest = spark.read.parquet(f"{folder}/manifest")
    return manifest.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file").select("file").mapInArrow(run, RECORD_FIELDS)


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _sql() -> str:
    chars = " || ".join(f"substr('{_BASE32}', CAST((v >> {s}) & 31 AS INT) + 1, 1)" for s in (15, 10, 5, 0))
    digest = f"list_aggregate(list_transform([CAST(concat('0x', substr(h, 5 * i + 1, 5)) AS BIGINT) FOR i IN range(8)], lambda v: {chars}), 'string_agg', '')"
    return f"""
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
    g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
    SELECT page_id, payload_bytes, {digest} AS payload_digest, CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN top <> page_id THEN top END AS refers_to FROM g
    """


@query("op7_warc", _sql())
def op7_warc(spark, folder):
    """Archive all pages, read the archives back, and report their records."""
    written = write_warc(table(spark, folder, "pages"), shared_folder(spark, "warc"))
    return read_warc(spark, written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
