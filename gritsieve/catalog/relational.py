"""Queries over sources, sinks, projections, filters, joins, sorts, sets and group positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritsieve.catalog.base import (
    MESSY_SCHEMA,
    VALID_SQL,
    date_sql,
    integer_sql,
    json_sql,
    messy,
    over_messy,
    query,
    records_sql,
    scratch_folder,
)
from gritsieve.functions import nested
from gritsieve.operators import aggregates, groups, relational as rel
from gritsieve.operators.quality import cell_rejects, error_report, keep_valid
from gritsieve.operators.scaling import drop_outliers, standard_scale
from gritsieve.schema import physical_numeric_columns
from gritsieve.sources import files, synthetic
from gritsieve.sources.files import read_table

c = F.col
_NA = ", ".join(f"'{t}'" for t in files.NA_TEXTS)


def _null_na(*columns: str) -> str:
    return ", ".join(f"CASE WHEN {x} NOT IN ({_NA}) THEN {x} END AS {x}" for x in columns)


def _written(spark, df):
    path = scratch_folder(spark)
    files.write_csv(df, path)
    return path


# -- sources and sinks -------------------------------------------------------------------
@query(
    "src_1",
    f"SELECT {_null_na('doc_id', 'text', 'lang', 'source', 'n_chars')} "
    "FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents)",
)
def src_1(spark, folder):
    """Whole texts with line breaks and quotes, written and read back as text."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return files.read_text_csv(spark, _written(spark, docs))


@query("src_2", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def src_2(spark, folder):
    path = _written(spark, read_table(spark, folder, "customer"))
    read = files.read_inferred_csv(spark, path, multi_line=False)
    return read.select(c("c_custkey").cast("bigint"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("src_3", "SELECT x AS column_name, (SELECT count(*) FROM supplier) AS n_rows FROM (VALUES ('s_suppkey'), ('s_name'), ('s_nationkey'), ('s_acctbal')) t(x)")
def src_3(spark, folder):
    path = _written(spark, read_table(spark, folder, "supplier"))
    rows = files.read_text_csv(spark, path, multi_line=False)
    names = F.array(*[F.lit(n) for n in files.csv_column_names(spark, path)])
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).select(F.explode(names).alias("column_name"), "n_rows")


@query("src_4", over_messy("SELECT flag, count(*) AS n FROM messy WHERE note IS NOT NULL GROUP BY flag"))
def src_4(spark, folder):
    files.text_view(messy(spark, folder), "raw_text")
    return spark.sql("SELECT flag, count(*) AS n FROM raw_text WHERE note IS NOT NULL GROUP BY flag")


def _uniform_sql(key: str, seed: str, stream: int) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws(':', CAST({seed} AS VARCHAR), '{stream}', CAST({key} AS VARCHAR))), 1, 12) AS BIGINT) + 1) / 281474976710656.0"


def _normal_sql(key: str, seed: str) -> str:
    return f"sqrt(-2 * ln({_uniform_sql(key, seed, 1)})) * cos(2 * pi() * {_uniform_sql(key, seed, 2)})"


@query("src_5", f"WITH f AS (SELECT avg(value) AS m, stddev_samp(value) AS s, count(value) AS n FROM events) SELECT round({_normal_sql('i', '42')} * s + m, 6) AS x FROM (SELECT unnest(range(n)) AS i, m, s FROM f)")
def src_5(spark, folder):
    """A normal sample as large as the event table, with the table's mean and deviation."""
    fit = read_table(spark, folder, "events").agg(F.avg("value"), F.stddev_samp("value"), F.count("value")).first()
    return synthetic.normal_sample(spark, fit[0], fit[1], fit[2]).select(F.round("x", 6).alias("x"))


@query("src_6", f"SELECT event_id, value, round(value + 0.1 * ({_normal_sql('event_id', '42')}), 6) AS noisy FROM events")
def src_6(spark, folder):
    events = read_table(spark, folder, "events").select("event_id", "value", c("value").alias("noisy"))
    return synthetic.add_noise(events, "noisy", key="event_id").withColumn("noisy", F.round("noisy", 6))


@query(
    "src_7",
    "WITH f AS (SELECT ascii(o_orderstatus) AS component, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1) "
    f"SELECT component, i, round({_normal_sql('i', '(component + 42)')} * s + m, 3) AS x FROM (SELECT component, unnest(range(n)) AS i, m, s FROM f)",
)
def src_7(spark, folder):
    """A mixture sample with one component per order status, fitted to the order table."""
    fits = read_table(spark, folder, "orders").groupBy(F.ascii("o_orderstatus").alias("component")).agg(
        F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("sd"), F.count(F.lit(1)).alias("size")
    )
    return synthetic.component_rows(fits).withColumn("x", F.round("x", 3))


@query("src_8", "SELECT * FROM customer ORDER BY md5('42:' || CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 10")
def src_8(spark, folder):
    return files.sample_rows(read_table(spark, folder, "customer"), 10, ["c_custkey"])


@query("src_9", "SELECT p.segment, p.label, count(c_custkey) AS n FROM (VALUES ('AUTOMOBILE', 'cars'), ('BUILDING', 'houses'), ('FURNITURE', 'chairs')) p(segment, label) LEFT JOIN customer ON c_mktsegment = p.segment GROUP BY 1, 2")
def src_9(spark, folder):
    names = spark.createDataFrame(
        [("AUTOMOBILE", "cars"), ("BUILDING", "houses"), ("FURNITURE", "chairs")], "segment string, label string"
    )
    counts = read_table(spark, folder, "customer").groupBy(c("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "segment", "left").select("segment", "label", F.coalesce("n", F.lit(0)).alias("n"))


@query("snk_1", f"SELECT {_null_na('conv_id', 'turn', 'role', 'text')} FROM (SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text FROM conversations)")
def snk_1(spark, folder):
    return files.read_text_csv(spark, _written(spark, read_table(spark, folder, "conversations")))


_REJECTED = tuple(MESSY_SCHEMA.columns)
_REJECTS_SQL = " UNION ALL ".join(
    f"SELECT row_id, '{n}' AS column_name, '{MESSY_SCHEMA.columns[n]}' AS semantic_type, {n} AS value FROM messy WHERE {n} IS NOT NULL AND ({VALID_SQL[n]}) IS NULL"
    for n in _REJECTED
)


_SUMMARY_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS column_name, '{MESSY_SCHEMA.columns[n]}' AS semantic_type, count(*) FILTER (WHERE {n} IS NOT NULL AND ({VALID_SQL[n]}) IS NULL) AS n_rows FROM messy"
    for n in _REJECTED
)


@query(
    "snk_2",
    over_messy(
        f", rejects AS ({_REJECTS_SQL}), summary AS ({_SUMMARY_SQL}) "
        "SELECT 'reject' AS part, 'run' AS run_id, column_name, semantic_type, value, count(*) AS n_rows FROM rejects GROUP BY column_name, semantic_type, value "
        "UNION ALL SELECT 'summary', 'run', column_name, semantic_type, CASE WHEN n_rows > 0 THEN 'invalid' ELSE 'valid' END, n_rows FROM summary"
    ),
)
def snk_2(spark, folder):
    """The error report of all columns, both parts written as tables and read back."""
    path = scratch_folder(spark)
    files.write_report(error_report(messy(spark, folder).select(*_REJECTED), MESSY_SCHEMA, "run"), path)
    named = lambda part: spark.read.parquet(f"{path}/{part}").withColumnRenamed("column", "column_name")
    rejects = named("rejects").select(F.lit("reject").alias("part"), "run_id", "column_name", "semantic_type", "value", "n_rows")
    summary = named("summary").select(
        F.lit("summary").alias("part"), "run_id", "column_name", "semantic_type", c("status").alias("value"), F.coalesce("n_invalid", F.lit(0)).alias("n_rows")
    )
    return rejects.unionByName(summary)


@query("snk_3", over_messy(_REJECTS_SQL))
def snk_3(spark, folder):
    rejects = cell_rejects(messy(spark, folder).select("row_id", *_REJECTED), MESSY_SCHEMA, "row_id")
    path = scratch_folder(spark)
    rejects.write.parquet(path)
    return spark.read.parquet(path).withColumnRenamed("column", "column_name")


# -- projections -------------------------------------------------------------------------
@query("prj_1", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def prj_1(spark, folder):
    return read_table(spark, folder, "orders").drop("o_orderdate", "o_orderpriority")


@query("prj_2", "SELECT l_orderkey, l_partkey, '...' AS filler, l_returnflag, l_linestatus FROM lineitem")
def prj_2(spark, folder):
    lines = read_table(spark, folder, "lineitem").drop("l_shipdate")
    return rel.edge_columns(lines, 2, "filler")


@query("prj_3", "SELECT c_custkey AS \"c_cus…\", c_name AS c_name, c_nationkey AS \"c_nat…\", c_mktsegment AS \"c_mkt…\" FROM customer")
def prj_3(spark, folder):
    return rel.short_names(read_table(spark, folder, "customer").drop("c_acctbal"), 6)


@query("prj_4", over_messy("SELECT id, revenue, budget FROM messy"))
def prj_4(spark, folder):
    df = messy(spark, folder).drop("row_id")
    return df.select(*MESSY_SCHEMA.numeric_columns(df))


@query("prj_5", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def prj_5(spark, folder):
    df = read_table(spark, folder, "customer")
    return df.select(*physical_numeric_columns(df))


_PROFIT = "try_cast(nullif(revenue, 'nan') AS DECIMAL(38,6)) - try_cast(budget AS DECIMAL(38,6))"


@query("prj_6", over_messy(f"SELECT row_id, CAST({_PROFIT} AS DOUBLE) AS profit FROM messy"))
def prj_6(spark, folder):
    df = rel.difference(messy(spark, folder), "revenue", "budget", "profit")
    return df.select("row_id", c("profit").cast("double").alias("profit"))


@query("prj_7", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def prj_7(spark, folder):
    k = nested.extract_dict(c("props"))["k"].try_cast("int")
    return read_table(spark, folder, "events").withColumn("k", k).select("event_id", "k")


@query("prj_8", over_messy("SELECT row_id, CASE WHEN items IS NOT NULL THEN replace(items, '''', '\"') ELSE items END AS items FROM messy"))
def prj_8(spark, folder):
    df = rel.overwrite_where(messy(spark, folder), "items", F.replace("items", F.lit("'"), F.lit('"')), c("items").isNotNull())
    return df.select("row_id", "items")


@query("prj_9", over_messy(f"SELECT row_id, CASE WHEN ({integer_sql('id')}) IS NOT NULL THEN CAST({integer_sql('id')} AS VARCHAR) ELSE id END AS id FROM messy"))
def prj_9(spark, folder):
    number = MESSY_SCHEMA.extractor("id")(c("id"))
    return rel.overwrite_where(messy(spark, folder), "id", number.cast("string"), number.isNotNull()).select("row_id", "id")


@query("prj_10", "SELECT n_nationkey, n_name, n_regionkey, '...' AS gap, CAST(1 AS INTEGER) AS one FROM nation")
def prj_10(spark, folder):
    return rel.beside(read_table(spark, folder, "nation"), gap="...", one=1)


# -- filters -----------------------------------------------------------------------------
@query("flt_1", over_messy("SELECT row_id, note FROM messy WHERE note IS NOT NULL AND items IS NOT NULL"))
def flt_1(spark, folder):
    return rel.not_null(messy(spark, folder), "note", "items").select("row_id", "note")


@query("flt_2", over_messy("SELECT row_id, revenue FROM messy WHERE try_cast(nullif(revenue, 'nan') AS DECIMAL(38,6)) > 0"))
def flt_2(spark, folder):
    return rel.numeric_where(messy(spark, folder), "revenue", 0).select("row_id", "revenue")


@query("flt_3", over_messy(r"SELECT row_id, regexp_full_match(revenue, '[0-9]+(\.[0-9]+)?') AS plain, contains(items, '\x') AS escaped FROM messy WHERE NOT regexp_full_match(items, '\[.*\]') OR contains(items, '\x')"))
def flt_3(spark, folder):
    df = messy(spark, folder)
    odd = rel.not_matching(df, "items", r"^\[.*\]\z").unionByName(rel.matching(df, "items", r"\\x"))
    return odd.select("row_id", c("revenue").rlike(r"^[0-9]+(\.[0-9]+)?\z").alias("plain"), c("items").rlike(r"\\x").alias("escaped"))


@query("flt_4", over_messy("SELECT row_id, homepage FROM messy WHERE homepage <> ''"))
def flt_4(spark, folder):
    return rel.not_empty(messy(spark, folder), "homepage").select("row_id", "homepage")


@query("flt_5", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount < l_tax")
def flt_5(spark, folder):
    lines = read_table(spark, folder, "lineitem")
    return lines.where(c("l_discount") < c("l_tax")).select("l_orderkey", "l_linenumber", "l_partkey")


@query("flt_6", over_messy("SELECT count(*) FILTER (WHERE regexp_full_match(day, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS matching, count(*) FILTER (WHERE NOT regexp_full_match(day, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS not_matching, count(*) FILTER (WHERE day IS NULL) AS nulls FROM messy"))
def flt_6(spark, folder):
    return rel.pattern_conformity(messy(spark, folder), "day")


@query("flt_7", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def flt_7(spark, folder):
    orders = read_table(spark, folder, "orders")
    return orders.where(c("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@query("flt_8", over_messy(f"SELECT row_id, items FROM messy WHERE json_type({json_sql('items')}) = 'ARRAY'"))
def flt_8(spark, folder):
    return rel.of_json_kind(messy(spark, folder), "items", "array").select("row_id", "items")


@query("flt_9", over_messy(f"SELECT row_id, day FROM messy WHERE ({date_sql('day')}) IS NOT NULL"))
def flt_9(spark, folder):
    return keep_valid(messy(spark, folder), "day", "ymd_datetime").select("row_id", "day")


_Z = "(SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) f"


@query("flt_10", f"SELECT event_id, round((value - m) / s, 6) AS z FROM events, {_Z} WHERE abs((value - m) / s) <= 2")
def flt_10(spark, folder):
    scaled = standard_scale(read_table(spark, folder, "events").select("event_id", c("value").alias("z")), ["z"])
    return drop_outliers(scaled, ["z"], 2.0).select("event_id", F.round("z", 6).alias("z"))


# -- joins -------------------------------------------------------------------------------
@query("jn_1", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def jn_1(spark, folder):
    buyers = read_table(spark, folder, "orders").where("o_totalprice > 400000").select(c("o_custkey").alias("c_custkey"))
    return rel.without_keys(read_table(spark, folder, "customer").select("c_custkey", "c_name"), buyers, "c_custkey")


@query("jn_2", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def jn_2(spark, folder):
    buyers = read_table(spark, folder, "orders").select(c("o_custkey").alias("c_custkey"))
    return rel.with_keys(read_table(spark, folder, "customer").select("c_custkey", "c_name"), buyers, "c_custkey")


@query(
    "jn_3",
    over_messy(
        f", lists AS (SELECT row_id, {json_sql('items')} AS j FROM messy) "
        "SELECT row_id, json_extract_string(e, '$.name') AS name FROM (SELECT row_id, unnest(json_extract(j, '$[*]')) AS e FROM lists WHERE json_type(j) = 'ARRAY')"
    ),
)
def jn_3(spark, folder):
    items = rel.explode_list(messy(spark, folder).select("row_id", "items"), "items", "e")
    return items.select("row_id", F.get_json_object("e", "$.name").alias("name"))


@query(
    "jn_4",
    over_messy(
        f", lists AS (SELECT row_id, {records_sql('items')} AS j FROM messy), "
        "parts AS (SELECT row_id, unnest(json_extract(j, '$[*]')) AS e FROM lists WHERE j IS NOT NULL), "
        "bridge AS (SELECT DISTINCT row_id, CAST(json_extract_string(e, '$.id') AS BIGINT) AS id FROM parts), "
        "dim AS (SELECT CAST(json_extract_string(e, '$.id') AS BIGINT) AS id, min(json_extract_string(e, '$.name')) AS name FROM parts GROUP BY 1) "
        "SELECT m.row_id, m.status, d.id, d.name FROM messy m JOIN bridge b ON b.row_id = m.row_id JOIN dim d ON d.id = b.id"
    ),
)
def jn_4(spark, folder):
    df = messy(spark, folder)
    dimension, bridge = rel.normalise(df, "row_id", "items", {"id": "bigint", "name": "string"}, "id")
    return rel.denormalise(df.select("row_id", "status"), bridge, dimension, "row_id", "id").select("row_id", "status", "id", "name")


@query("jn_5", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem), 4) AS above_mean FROM lineitem")
def jn_5(spark, folder):
    lines = read_table(spark, folder, "lineitem")
    mean = lines.agg(F.avg("l_extendedprice")).scalar()
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", F.round(c("l_extendedprice") - mean, 4).alias("above_mean"))


# -- windows and group positions ---------------------------------------------------------
@query("win_1", "SELECT month, o_orderpriority, n FROM (SELECT month(o_orderdate) AS month, o_orderpriority, count(*) AS n, row_number() OVER (PARTITION BY month(o_orderdate) ORDER BY count(*) DESC, o_orderpriority) AS rn FROM orders GROUP BY 1, 2) WHERE rn = 1")
def win_1(spark, folder):
    counts = read_table(spark, folder, "orders").groupBy(F.month("o_orderdate").cast("bigint").alias("month"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return groups.top_per_group(counts, ["month"], [F.desc("n"), F.asc("o_orderpriority")])


@query("win_2", "SELECT l_partkey, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY l_partkey) AS BIGINT) AS running FROM lineitem GROUP BY l_partkey")
def win_2(spark, folder):
    counts = read_table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return groups.running_total(counts, "l_partkey", "n", "running", unique=True)


_NULLED = "CASE WHEN l_suppkey % 10 <> 0 THEN l_suppkey END"


@query("win_3", f"SELECT l_orderkey, l_partkey, l_linenumber, supplier, CASE WHEN supplier IS NOT NULL THEN count(*) OVER (PARTITION BY supplier) END AS n FROM (SELECT *, {_NULLED} AS supplier FROM lineitem)")
def win_3(spark, folder):
    lines = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.when(c("l_suppkey") % 10 != 0, c("l_suppkey")).alias("supplier")
    )
    return groups.group_size(lines, "supplier", "n")


@query("win_4", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position FROM events")
def win_4(spark, folder):
    events = read_table(spark, folder, "events").select("event_id", "user_id")
    return groups.position_in_group(events, ["user_id"], "event_id")


@query("win_5", "SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS is_duplicate FROM documents")
def win_5(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return groups.flag_duplicates(docs, ["digest"]).select("doc_id", "is_duplicate")


@query("win_6", "SELECT doc_id, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) > 1 AS is_repeat FROM documents")
def win_6(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("digest"))
    return groups.flag_repeats(docs, ["digest", "lang"], "doc_id").select("doc_id", "is_repeat")


# -- sorts and limits --------------------------------------------------------------------
@query("srt_1", over_messy("SELECT row_id, note, revenue FROM messy ORDER BY note ASC NULLS LAST"))
def srt_1(spark, folder):
    return rel.sorted_by(messy(spark, folder), c("note")).select("row_id", "note", "revenue")


@query("srt_2", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS customer FROM orders ORDER BY CAST(o_custkey AS VARCHAR) DESC, o_orderkey LIMIT 20")
def srt_2(spark, folder):
    orders = read_table(spark, folder, "orders").select("o_orderkey", c("o_custkey").cast("string").alias("customer"))
    return orders.orderBy(F.desc("customer"), F.asc("o_orderkey")).limit(20)


@query("lim_1", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def lim_1(spark, folder):
    return read_table(spark, folder, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("lim_2", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 2 LIMIT 1")
def lim_2(spark, folder):
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return rel.nth_row(orders, 3, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("lim_3", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, dense_rank() OVER (ORDER BY l_quantity DESC) AS r FROM lineitem) WHERE r = 3")
def lim_3(spark, folder):
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return rel.nth_value_rows(lines, 3, "l_quantity")


@query("lim_4", "SELECT o_orderkey, o_orderstatus FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) AS a, row_number() OVER (ORDER BY o_orderkey DESC) AS b FROM orders) WHERE a <= 3 OR b <= 3")
def lim_4(spark, folder):
    return rel.head_and_tail(read_table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), 3, "o_orderkey")


@query("lim_5", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
def lim_5(spark, folder):
    return aggregates.value_counts(read_table(spark, folder, "orders"), "o_custkey", 10)


# -- sets --------------------------------------------------------------------------------
@query("set_1", "SELECT name, nation FROM (SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier)")
def set_1(spark, folder):
    customers = read_table(spark, folder, "customer").select(c("c_name").alias("name"), c("c_nationkey").alias("nation"))
    suppliers = read_table(spark, folder, "supplier").select(c("s_name").alias("name"), c("s_nationkey").alias("nation"))
    return rel.concatenate(customers, suppliers)


@query("set_2", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def set_2(spark, folder):
    return read_table(spark, folder, "orders").select("o_orderstatus", "o_orderpriority").dropDuplicates()


@query("set_3", "SELECT DISTINCT label FROM embeddings")
def set_3(spark, folder):
    return rel.distinct_values(read_table(spark, folder, "embeddings"), "label")
