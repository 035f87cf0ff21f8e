"""Quoted CSV read by many tasks, with row numbers from file position.

Spark's text reader cuts a file into ranges at line breaks, but a line break may lie inside a
quoted cell. A line leads from one of two states, outside or inside quotes, to one of them; so
each range is first scanned from both, which gives its exit state and the records it begins
under either. A pass over the ranges, a row each, finds where each range really starts and how
many records lie before it. In a second scan every range gives out its records with their
numbers; a record that crosses borders is put together from its parts by its number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

OUTSIDE, INSIDE = 0, 1
QUOTE, COMMA = '"', ","


def leaves_inside(line: str, inside: bool) -> bool:
    """Whether the line's end lies inside quotes. Only a quote that begins a cell opens one; doubled quotes stay inside."""
    at, end = 0, len(line)
    while True:
        if not inside:
            if not line.startswith(QUOTE, at):
                at = line.find(COMMA, at) + 1
                if not at:
                    return False
                continue
            at += 1
        while True:
            at = line.find(QUOTE, at)
            if at < 0:
                return True
            if at + 1 < end and line[at + 1] == QUOTE:
                at += 2
            else:
                break
        inside = False
        at = line.find(COMMA, at) + 1
        if not at:
            return False


@dataclass(frozen=True)
class Range:
    """Where the scan of a range starts: inside quotes or not, and the number of its first own record."""

    inside: bool
    first: int


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, key, start) of every line; key stands for the file, start for the range. A task reads its ranges in order."""
    meta = F.col("_metadata")
    return spark.read.text(path, lineSep="\n").select("value", F.xxhash64(meta["file_path"]).alias("key"), meta["file_block_start"].alias("start"))


def _columns(batch: pa.RecordBatch) -> Iterator[tuple[str, tuple[int, int]]]:
    values, keys, starts = (batch.column(i).to_pylist() for i in range(3))
    return zip(values, zip(keys, starts))


def _range_summaries(lines: DataFrame) -> DataFrame:
    """(key, start, exit0, exit1, n0, n1): the exit state and the records begun, by the state the range is entered in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            for line, where in _columns(batch):
                state = found.get(where)
                if state is None:
                    state = found[where] = [False, True, 0, 0]
                state[2] += not state[0]
                state[3] += not state[1]
                if QUOTE in line:
                    same = state[0] == state[1]
                    state[0] = leaves_inside(line, state[0])
                    state[1] = state[0] if same else leaves_inside(line, state[1])
        rows = [(*where, int(a), int(b), n0, n1) for where, (a, b, n0, n1) in found.items()]
        names = ["key", "start", "exit0", "exit1", "n0", "n1"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names)

    return lines.mapInArrow(run, "key long, start long, exit0 long, exit1 long, n0 long, n1 long")


def file_ranges(spark: SparkSession, path: str) -> tuple[dict[tuple[int, int], Range], dict[int, int]]:
    """Every range's start, and the number of each file's header record.

    One small row a range reaches the driver, as many as Spark's own plan of the scan has.
    Files are in order of their paths; the header of each is no row.
    """
    names = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"))  # lists, reads nothing
    order = [(r["path"], r["key"]) for r in names.select("path", F.xxhash64("path").alias("key")).orderBy("path").collect()]
    if len({key for _, key in order}) < len(order):
        raise ValueError("two files share a hash")
    by_file: dict[int, list] = {key: [] for _, key in order}
    for r in _range_summaries(_lines(spark, path)).collect():
        by_file[r["key"]].append(r)
    ranges, headers, number = {}, {}, 0
    for _, key in order:
        inside, header = False, True
        for r in sorted(by_file[key], key=lambda r: r["start"]):
            if header:
                number -= 1  # the header takes the number before the file's first row
                headers[key] = number
                header = False
            ranges[key, r["start"]] = Range(inside, number)
            number += r["n1" if inside else "n0"]
            inside = bool(r["exit1" if inside else "exit0"])
    return ranges, headers


PIECES = "number long, start long, crosses boolean, header boolean, record string"


def record_pieces(lines: DataFrame, ranges: dict[tuple[int, int], Range], headers: dict[int, int]) -> DataFrame:
    """(number, start, crosses, header, record): whole records, and the parts of those that cross a range's border."""
    sent = lines.sparkSession.sparkContext.broadcast((ranges, headers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first = sent.value
        out: list[tuple[int, int, bool, bool, str]] = []
        where, number, inside, foreign, held = None, 0, False, False, []

        def close(crosses: bool) -> None:
            key, start = where
            out.append((number, start, crosses, number == first[key], "\n".join(held)))

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()))],
                ["number", "start", "crosses", "header", "record"],
            )
            out.clear()
            return batch

        for batch in batches:
            for line, here in _columns(batch):
                if here != where:
                    if held:
                        close(True)  # goes on in the next range
                        held = []
                    where = here
                    inside = foreign = known[here].inside
                    number = known[here].first - 1 if inside else known[here].first
                held.append(line)
                if QUOTE in line:
                    inside = leaves_inside(line, inside)
                if not inside:
                    close(foreign)
                    held, foreign = [], False
                    number += 1
            if out:
                yield flush()
        if held:
            close(True)
        if out:
            yield flush()

    return lines.mapInArrow(run, PIECES)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(number, record) of all records but the headers, numbered from 0 in the files' order, whatever the ranges."""
    ranges, headers = file_ranges(spark, path)
    pieces = record_pieces(_lines(spark, path), ranges, headers)
    records = pieces.where("NOT crosses")
    # the last line of a file without a closing quote crosses no border, but its record is left open
    parts = pieces.where("crosses").groupBy("number").agg(
        F.sort_array(F.collect_list(F.struct("start", "record"))).alias("parts"), F.max("header").alias("header")
    )
    joined = parts.select("number", "header", F.array_join(F.col("parts.record"), "\n").alias("record"))
    return records.select("number", "header", "record").unionByName(joined).where("NOT header").select("number", "record")


def read_split_csv(spark: SparkSession, path: str, schema: StructType, options: dict, number: str | None = None) -> DataFrame:
    """The text columns of every row, in the order of the schema; ``number`` adds each row's place in the files.

    Empty lines are no rows, as for Spark's reader, but they take a number. Lines end with a
    line feed, before which a carriage return is dropped. Compressed files are one range each.
    """
    records = read_records(spark, path).withColumn("record", F.regexp_replace("record", "\r$", ""))
    cells = F.from_csv("record", _ddl(schema), {**options, "header": "false", "multiLine": "true"})
    rows = records.where("record <> ''").select("number", cells.alias("cells"))
    extra = [F.col("number").alias(number)] if number else []
    return rows.select(*[F.col("cells").getField(f.name).alias(f.name) for f in schema], *extra)


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` STRING" for f in schema)
