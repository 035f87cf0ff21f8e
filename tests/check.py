"""Run the catalogue's queries beside their SQL in DuckDB: python tests/check.py [folder] [name ...]"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry_module  # noqa: E402
from gritsieve.session import local_session  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        [tuple(_plain(row[i]) for i in order) for row in rows], key=lambda r: tuple((v is None, str(v)) for v in r)
    )


def compare(spark, con, folder: str, name: str) -> tuple[str, float]:
    """'ok', 'rows only' or what differs, and the Spark seconds."""
    start = time.time()
    df = entry_module.queries()[name](spark, folder)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - start
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return f"rows only ({len(ours[1])})", seconds
    result = con.execute(sql)
    theirs = rows_of([d[0] for d in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}", seconds
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows != {len(theirs[1])}", seconds
    wrong = [(a, b) for a, b in zip(*(x[1] for x in (ours, theirs))) if a != b]
    types = {(type(x).__name__, type(y).__name__) for a, b in zip(ours[1], theirs[1]) for x, y in zip(a, b) if x is not None and type(x) is not type(y)}
    if wrong:
        return f"{len(wrong)} of {len(ours[1])} rows differ, e.g. {wrong[0]}", seconds
    if types:
        return f"types differ: {types}", seconds
    return f"ok ({len(ours[1])})", seconds


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(entry_module.queries())
    spark = local_session(os.environ.get("CPUS", "8"))
    con = connect(folder)
    bad = 0
    for name in names:
        try:
            verdict, seconds = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001
            verdict, seconds = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0.0
        if not verdict.startswith(("ok", "rows only")):
            bad += 1
            print(f"{name:10s} {seconds:6.2f}s {verdict}", flush=True)
        elif os.environ.get("VERBOSE"):
            print(f"{name:10s} {seconds:6.2f}s {verdict}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
