"""Queries over validation, column and row removal, duplicates and the cleaning run."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritsieve.catalog.base import MESSY, MESSY_SCHEMA, ORACLES, VALID_SQL, messy, over_messy, query, scratch_folder, tagged
from gritsieve.operators import duplicates, quality
from gritsieve.plans.cleaning import clean
from gritsieve.sources.files import read_table
from gritsieve.streaming.validation import running_rejects, running_summary, validate_stream

c = F.col


def _bad(n: str) -> str:
    return f"{n} IS NOT NULL AND ({VALID_SQL[n]}) IS NULL"


@query(
    "qlt_1",
    over_messy(
        " UNION ALL ".join(
            f"SELECT '{n}' AS column_name, '{t}' AS semantic_type, CASE WHEN count(*) FILTER (WHERE {_bad(n)}) > 0 THEN 'invalid' ELSE 'valid' END AS status, "
            f"count({n}) AS n_values, count(*) FILTER (WHERE {_bad(n)}) AS n_invalid, count(DISTINCT {n}) FILTER (WHERE {_bad(n)}) AS n_distinct_bad FROM messy"
            for n, t in MESSY_SCHEMA.columns.items()
        )
        + " UNION ALL SELECT 'row_id', NULL, 'unregistered', count(row_id), 0, 0 FROM messy"
    ),
)
def qlt_1(spark, folder):
    return quality.validation_summary(messy(spark, folder), MESSY_SCHEMA).withColumnRenamed("column", "column_name")


@query(
    "qlt_2",
    over_messy(
        " UNION ALL ".join(
            f"SELECT '{n}' AS column_name, '{t}' AS semantic_type, {n} AS value, count(*) AS n_rows FROM messy WHERE {_bad(n)} GROUP BY {n}"
            for n, t in MESSY_SCHEMA.columns.items()
        )
    ),
)
def qlt_2(spark, folder):
    return quality.distinct_rejects(messy(spark, folder), MESSY_SCHEMA).withColumnRenamed("column", "column_name")


def _streamed(spark, folder) -> str:
    """The messy table, a file per task, read as a stream in three batches; the folder of what was summed up."""
    seen = scratch_folder(spark)
    rows = messy(spark, folder)
    rows.write.parquet(f"{seen}/rows")
    files = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 3)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{seen}/rows")
    validate_stream(stream, MESSY_SCHEMA, f"{seen}/sums", f"{seen}/log", ("id", "revenue", "budget")).awaitTermination()
    return f"{seen}/sums"


@query("qlt_2_stream", ORACLES["qlt_2"])
def qlt_2_stream(spark, folder):
    """The distinct rejects of a stream, merged over its batches."""
    return running_rejects(spark, _streamed(spark, folder)).withColumnRenamed("column", "column_name")


@query("qlt_1_stream", ORACLES["qlt_1"])
def qlt_1_stream(spark, folder):
    """The validation summary of a stream, merged over its batches."""
    return running_summary(spark, _streamed(spark, folder)).withColumnRenamed("column", "column_name")


_FLAT_COLUMNS = tuple(n for n in MESSY_SCHEMA.columns if n not in ("items", "info"))
_ITEMS, _INFO = VALID_SQL["items"], VALID_SQL["info"]


@query(
    "qlt_3",
    over_messy(
        "SELECT row_id, " + ", ".join(f"{VALID_SQL[n]} AS {n}" for n in _FLAT_COLUMNS)
        + f", CAST(json_array_length({_ITEMS}) AS INTEGER) AS n_items, json_extract_string({_ITEMS}, '$[0].name') AS first_item, "
        f"json_extract_string({_INFO}, '$.id') AS info_id, json_extract_string({_INFO}, '$.name') AS info_name FROM messy"
    ),
)
def qlt_3(spark, folder):
    """All columns typed, invalid cells null; of the nested ones what SQL can show alike."""
    typed, _ = quality.null_out_invalid(messy(spark, folder), MESSY_SCHEMA, "row_id")
    nested = [
        F.size("items").alias("n_items"), F.col("items")[0]["name"].alias("first_item"),
        F.col("info")["id"].alias("info_id"), F.col("info")["name"].alias("info_name"),
    ]
    return typed.select("row_id", *_FLAT_COLUMNS, *nested)


_COPIED = "SELECT o_custkey, o_orderstatus, o_orderpriority, o_orderkey FROM orders"


@query("qlt_4", f"SELECT o_custkey, o_orderstatus, o_orderpriority, min(o_orderkey) AS o_orderkey FROM ({_COPIED}) GROUP BY 1, 2, 3")
def qlt_4(spark, folder):
    orders = read_table(spark, folder, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey")
    return duplicates.drop_exact_duplicates(orders, "o_orderkey")


@query("qlt_5", over_messy("SELECT row_id, id, flag, note FROM messy"))
def qlt_5(spark, folder):
    return quality.drop_blank_columns(messy(spark, folder).select("row_id", "id", "flag", "note", "blank"))


@query("qlt_6", over_messy("SELECT row_id, id, flag FROM messy"))
def qlt_6(spark, folder):
    return quality.drop_sparse_columns(messy(spark, folder).select("row_id", "id", "flag", "note", "homepage", "blank"))


@query("qlt_7", over_messy("SELECT row_id, id, flag, homepage FROM messy"))
def qlt_7(spark, folder):
    return quality.drop_mostly_missing(messy(spark, folder).select("row_id", "id", "flag", "note", "homepage", "blank"), 80)


_CLEANED = ("title", "flag", "day", "status")
_CLEANED_NUMBERS = ("id", "revenue", "budget")
_KEPT = (*_CLEANED_NUMBERS, *_CLEANED, "items", "info")
_NESTED_SQL = (
    f"CAST(json_array_length({_ITEMS}) AS INTEGER) AS n_items, json_extract_string({_ITEMS}, '$[0].name') AS first_item, "
    f"json_extract_string({_INFO}, '$.id') AS info_id, json_extract_string({_INFO}, '$.name') AS info_name"
)


def _nested() -> list:
    """Of the nested columns what SQL can show alike."""
    return [
        F.size("items").alias("n_items"), F.col("items")[0]["name"].alias("first_item"),
        F.col("info")["id"].alias("info_id"), F.col("info")["name"].alias("info_name"),
    ]


@query(
    "qlt_8",
    over_messy(
        f", numbered AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(n for n in MESSY if n != 'row_id')} ORDER BY row_id) AS rn FROM messy), "
        "firsts AS (SELECT * FROM numbered WHERE rn = 1), "
        "typed AS (SELECT row_id, " + ", ".join(f"{VALID_SQL[n]} AS {n}" for n in (*_CLEANED, *_CLEANED_NUMBERS)) + f", {_NESTED_SQL} FROM firsts) "
        "SELECT 'table' AS part, row_id, " + ", ".join(_CLEANED) + ", "
        + ", ".join(f"round(({n} - avg({n}) OVER ()) / stddev_pop({n}) OVER (), 6) AS {n}" for n in _CLEANED_NUMBERS)
        + ", n_items, first_item, info_id, info_name FROM typed"
        + "".join(
            f" UNION ALL BY NAME SELECT 'rejects' AS part, row_id, '{n}' AS column_name, '{MESSY_SCHEMA.columns[n]}' AS semantic_type, {n} AS value FROM firsts WHERE {_bad(n)}"
            for n in _KEPT
        )
        + " UNION ALL BY NAME SELECT 'duplicates' AS part, row_id FROM numbered WHERE rn > 1"
        + "".join(
            f" UNION ALL BY NAME SELECT 'dropped' AS part, '{n}' AS column_name FROM firsts HAVING count(*) - count({n}) > 0.5 * count(*)"
            for n in MESSY_SCHEMA.columns
        )
    ),
)
def qlt_8(spark, folder):
    """The whole cleaning run: its table with all columns, rejects, duplicates and dropped columns, as tagged rows."""
    found = clean(messy(spark, folder), MESSY_SCHEMA, "row_id")
    numbers = [F.round(n, 6).alias(n) for n in _CLEANED_NUMBERS]
    dropped = spark.createDataFrame([(n,) for n in found.dropped_columns], "column_name string")
    parts = {
        "table": found.table.select("row_id", *_CLEANED, *numbers, *_nested()),
        "rejects": found.rejects.withColumnRenamed("column", "column_name"),
        "duplicates": found.duplicates.select("row_id"),
        "dropped": dropped,
    }
    return tagged(parts)


# -- duplicates --------------------------------------------------------------------------
_FLAGGED = (
    "pairs AS (SELECT o_custkey, o_orderpriority, o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM orders), "
    "flagged AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS count, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM pairs WHERE n > 1)"
)


def _pairs(spark, folder):
    return read_table(spark, folder, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")


@query("dup_1", f"WITH {_FLAGGED} SELECT o_custkey, o_orderpriority, o_orderkey, count FROM flagged WHERE rn = 1")
def dup_1(spark, folder):
    return duplicates.find_duplicates(_pairs(spark, folder), "o_orderkey", ("o_custkey", "o_orderpriority"))


@query("dup_2", "SELECT doc_id, n_chars, \"count\" FROM (SELECT min(doc_id) AS doc_id, n_chars, count(*) AS \"count\" FROM documents GROUP BY text, n_chars HAVING count(*) > 1)")
def dup_2(spark, folder):
    """Documents with equal texts, grouped by a digest of the whole text."""
    docs = read_table(spark, folder, "documents").select("doc_id", "n_chars", duplicates.row_digest(c("text")).alias("digest"))
    return duplicates.find_duplicates(docs, "doc_id", ("digest", "n_chars")).select("doc_id", "n_chars", "count")


@query("dup_3", f"WITH {_FLAGGED} SELECT 'keep_first' AS kept, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderpriority "
       "UNION ALL SELECT 'drop_first', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM flagged WHERE rn = 1)")
def dup_3(spark, folder):
    pairs = _pairs(spark, folder)
    kept = [
        duplicates.remove_duplicates(pairs, "o_orderkey", ("o_custkey", "o_orderpriority"), mode).select(F.lit(mode).alias("kept"), "o_orderkey")
        for mode in ("keep_first", "drop_first")
    ]
    return kept[0].unionByName(kept[1])
