"""Queries over text, number, date, category and nested-text functions, schemas and hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritsieve.catalog.base import (
    MESSY_SCHEMA,
    VALID_SQL,
    boolean_sql,
    date_sql,
    dict_sql,
    float_sql,
    integer_sql,
    json_sql,
    messy,
    over_messy,
    query,
    records_sql,
    string_sql,
)
from gritsieve.functions.binding import bind
from gritsieve.functions import nested, scalars, text
from gritsieve.operators.analyze import analyze, register_analysis
from gritsieve.operators.quality import columns_within, detect_types
from gritsieve.schema import extract_columns, register_type, verify_column_names
from gritsieve.sources.files import read_table

c = F.col


def _messy_query(name: str, source: str, column, sql: str, alias: str = "value") -> None:
    """row_id and one computed column over the whole messy table."""

    @query(name, over_messy(f"SELECT row_id, {sql} AS {alias} FROM messy"))
    def run(spark, folder):
        return messy(spark, folder).select("row_id", column(c(source)).alias(alias))


# -- text --------------------------------------------------------------------------------
_messy_query("str_1", "title", text.extract_string, string_sql("title"))
_messy_query("str_2", "title", text.is_string, f"({string_sql('title')} IS NOT NULL)")
_messy_query("str_3", "items", lambda x: text.replace_text(x, "'", '"'), "replace(items, '''', '\"')")
_messy_query("str_4", "flag", lambda x: text.same_text(x, "TRUE"), "(lower(flag) = 'true')")

_FLAT = "translate(title, chr(10) || chr(9), '  ')"
_SHORT = f"CASE WHEN length({_FLAT}) > 8 THEN left({_FLAT}, 7) || '…' ELSE {_FLAT} END"


def _padded(justify: str, body: str, width: int) -> str:
    if justify == "left":
        return f"rpad({body}, greatest(length({body}), {width})::INT, ' ')"
    if justify == "right":
        return f"lpad({body}, greatest(length({body}), {width})::INT, ' ')"
    gap = f"greatest({width} - length({body}), 0)"
    return f"repeat(' ', ({gap}) // 2) || {body} || repeat(' ', ({gap}) - ({gap}) // 2)"


@query(
    "str_5",
    over_messy(
        "SELECT row_id, "
        + ", ".join(
            f"CASE WHEN {string_sql('title')} IS NULL THEN repeat(' ', 10) ELSE {_padded(j, _SHORT, 10)} END AS {j}_text"
            for j in ("left", "right", "center")
        )
        + " FROM messy"
    ),
)
def str_5(spark, folder):
    title = c("title")
    return messy(spark, folder).select(
        "row_id", *[text.format_string(title, 8, 10, j).alias(f"{j}_text") for j in (text.LEFT, text.RIGHT, text.CENTER)]
    )


_CENTS = "CAST(ROUND(o_totalprice * 100) AS BIGINT)"


def _engineering_sql(n: str) -> str:
    """Engineering form of a positive integer with four to twelve digits."""
    third = f"((length(({n})::VARCHAR) - 1) // 3 * 3)"
    unit = f"(10 ** ({third} - 3))::BIGINT"
    rest = f"(({n}) % {unit})"
    up = f"(CASE WHEN 2 * {rest} > {unit} OR (2 * {rest} = {unit} AND ({n}) // {unit} % 2 = 1) THEN 1 ELSE 0 END)"
    q = f"(({n}) // {unit} + {up})"
    return f"printf('%d.%03de%d', {q} // 1000, {q} % 1000, {third})"


@query("str_6", f"SELECT o_orderkey, {_engineering_sql(_CENTS)} AS shown FROM orders")
def str_6(spark, folder):
    cents = F.round(c("o_totalprice") * 100).cast("bigint")
    return read_table(spark, folder, "orders").select("o_orderkey", text.format_engineering(cents).alias("shown"))


_BIG = f"CASE WHEN length({_CENTS}::VARCHAR) > 7 THEN {_engineering_sql(_CENTS)} ELSE {_CENTS}::VARCHAR END"
_LABEL = "CASE WHEN length(o_orderpriority) > 7 THEN left(o_orderpriority, 6) || '…' ELSE o_orderpriority END"


@query(
    "str_7",
    f"SELECT o_orderkey, lpad(CASE WHEN length(b) > 7 THEN left(b, 6) || '…' ELSE b END, 9, ' ') AS number_text, "
    f"rpad(l, 9, ' ') AS label_text, rpad(CASE WHEN late THEN 'True' ELSE 'False' END, 9, ' ') AS flag_text "
    f"FROM (SELECT o_orderkey, {_BIG} AS b, {_LABEL} AS l, o_orderdate >= TIMESTAMP '1998-01-01' AS late FROM orders)",
)
def str_7(spark, folder):
    df = read_table(spark, folder, "orders").select(
        "o_orderkey",
        F.round(c("o_totalprice") * 100).cast("bigint").alias("number_text"),
        c("o_orderpriority").alias("label_text"),
        (c("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")).alias("flag_text"),
    )
    shown = [text.format_value(c(f.name), f.dataType, 7, 9).alias(f.name) for f in df.schema if f.name != "o_orderkey"]
    return df.select("o_orderkey", *shown)


# -- numbers and booleans ----------------------------------------------------------------
_messy_query("num_1", "id", scalars.extract_integer, integer_sql("id"))
_messy_query("num_2", "id", scalars.is_integer, f"({integer_sql('id')} IS NOT NULL)")
_messy_query("num_3", "revenue", scalars.extract_float, float_sql("revenue"))
_messy_query("num_4", "revenue", scalars.is_float, f"({float_sql('revenue')} IS NOT NULL)")
_messy_query("num_5", "revenue", lambda x: scalars.to_numeric(x).cast("double"), "CAST(CASE WHEN revenue <> 'nan' THEN try_cast(revenue AS DECIMAL(38,6)) END AS DOUBLE)")


@query("num_6", "SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS rounded FROM orders")
def num_6(spark, folder):
    return read_table(spark, folder, "orders").select("o_orderkey", F.round("o_totalprice").cast("bigint").alias("rounded"))


@query(
    "num_7",
    "SELECT event_id, round(2.0 * exp(-0.5 * ((value - 50) / 20) ** 2) / (20 * sqrt(2 * pi())), 8) AS density FROM events",
)
def num_7(spark, folder):
    density = scalars.normal_pdf(c("value"), 50.0, 20.0, 2.0)
    return read_table(spark, folder, "events").select("event_id", F.round(density, 8).alias("density"))


_messy_query("boo_1", "flag", scalars.extract_boolean, boolean_sql("flag"))


@query(
    "boo_2",
    over_messy(
        f"SELECT row_id, ({boolean_sql('flag')} IS NOT NULL) AS stripped, coalesce(lower(flag) IN ('true', 'false'), false) AS exact FROM messy"
    ),
)
def boo_2(spark, folder):
    return messy(spark, folder).select(
        "row_id", scalars.is_boolean(c("flag")).alias("stripped"), scalars.is_boolean(c("flag"), exact=True).alias("exact")
    )


# -- dates and categories ----------------------------------------------------------------
_messy_query("dat_1", "day", scalars.extract_date, date_sql("day"))
_messy_query("dat_2", "day", scalars.is_date, f"({date_sql('day')} IS NOT NULL)")
_messy_query(
    "dat_3", "day", scalars.is_datetime_text,
    "coalesce(regexp_full_match(day, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_strptime(day, '%Y-%m-%d') IS NOT NULL, false)",
)
_messy_query("dat_4", "day", lambda x: scalars.release_month(x).cast("bigint"), f"CAST(month({date_sql('day')}) AS BIGINT)")
_messy_query("cat_1", "status", lambda x: scalars.extract_category(x, ("F", "O", "P")), VALID_SQL["status"])
_messy_query("cat_2", "status", lambda x: scalars.is_category(x, ("F", "O", "P")), f"({VALID_SQL['status']} IS NOT NULL)")

# -- nested texts ------------------------------------------------------------------------
_messy_query(
    "jsn_1", "items", nested.object_kind,
    f"CASE json_type({json_sql('items')}) WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' END",
)


def _elements_sql(source: str, field: str) -> str:
    return f"json_extract_string({source}, '$[0].{field}')"


@query(
    "jsn_2",
    over_messy(
        f"SELECT row_id, {_elements_sql(records_sql('items'), 'id')} AS first_id, {_elements_sql(records_sql('items'), 'name')} AS first_name FROM messy"
    ),
)
def jsn_2(spark, folder):
    rows = nested.extract_records(c("items"))
    return messy(spark, folder).select("row_id", rows[0]["id"].alias("first_id"), rows[0]["name"].alias("first_name"))


@query(
    "jsn_3",
    over_messy(f"SELECT row_id, json_extract_string({dict_sql('info')}, '$.name') AS name FROM messy"),
)
def jsn_3(spark, folder):
    return messy(spark, folder).select("row_id", nested.extract_dict(c("info"))["name"].alias("name"))


@query("jsn_4", over_messy(f"SELECT count({records_sql('items')}) AS lists, count({dict_sql('info')}) AS dicts FROM messy"))
def jsn_4(spark, folder):
    return messy(spark, folder).agg(
        F.count(nested.extract_records(c("items"))).alias("lists"), F.count(nested.extract_dict(c("info"))).alias("dicts")
    )


# texts with trailing commas, which JSON has no notation for
@query(
    "jsn_5",
    "SELECT event_id, '[{\"k\":' || user_id || '},{\"k\":' || event_id || '}]' AS json_text FROM events",
)
def jsn_5(spark, folder):
    literal = F.concat(F.lit("[{'k': "), c("user_id").cast("string"), F.lit(",}, {'k': "), c("event_id").cast("string"), F.lit("},]"))
    found = nested.extract_object(literal, python_fallback=True)
    return read_table(spark, folder, "events").select("event_id", F.regexp_replace(found, " ", "").alias("json_text"))


@query(
    "jsn_6",
    over_messy(
        f"SELECT row_id, json_extract_string({dict_sql('info')}, '$.id') AS id, json_extract_string({dict_sql('info')}, '$.name') AS name FROM messy"
    ),
)
def jsn_6(spark, folder):
    found = nested.extract_dict(c("info"))
    return messy(spark, folder).select("row_id", found["id"].alias("id"), found["name"].alias("name"))


_messy_query("jsn_7", "info", nested.is_dict, f"({dict_sql('info')} IS NOT NULL)")
_messy_query(
    "jsn_8", "items", lambda x: bind(nested.extract_records(x), lambda rows: F.when(rows.isNotNull(), F.size(rows))).cast("bigint"),
    f"CAST(json_array_length({records_sql('items')}) AS BIGINT)",
)
_messy_query("jsn_9", "items", nested.is_records, f"({records_sql('items')} IS NOT NULL)")
_messy_query(
    "jsn_10", "items", lambda x: nested.list_length(x).cast("bigint"),
    f"CAST(CASE WHEN json_type({json_sql('items')}) = 'ARRAY' THEN json_array_length({json_sql('items')}) END AS BIGINT)",
)


@query(
    "jsn_11",
    over_messy(
        f", lists AS (SELECT row_id, {json_sql('items')} AS j FROM messy) "
        "SELECT row_id, json_extract_string(e, '$.id') AS id, json_extract_string(e, '$.name') AS name "
        "FROM (SELECT row_id, unnest(json_extract(j, '$[*]')) AS e FROM lists WHERE json_type(j) = 'ARRAY')"
    ),
)
def jsn_11(spark, folder):
    items = messy(spark, folder).select("row_id", F.explode(nested.list_elements(c("items"))).alias("e"))
    return items.select("row_id", F.get_json_object("e", "$.id").alias("id"), F.get_json_object("e", "$.name").alias("name"))


@query(
    "jsn_12",
    "SELECT o_orderkey, '{\"status\":\"' || o_orderstatus || '\",\"customer\":' || o_custkey || '}' AS json_text FROM orders",
)
def jsn_12(spark, folder):
    pair = F.struct(c("o_orderstatus").alias("status"), c("o_custkey").alias("customer"))
    return read_table(spark, folder, "orders").select("o_orderkey", nested.to_json_text(pair).alias("json_text"))


@query(
    "jsn_13",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def jsn_13(spark, folder):
    found = nested.extract_dict(c("props"))
    return read_table(spark, folder, "events").select("event_id", found["k"].try_cast("bigint").alias("k"))


# -- schema ------------------------------------------------------------------------------
def _messy_columns_sql(pick) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS column_name, '{pick(n)}' AS value, count({n}) AS n_values FROM messy" for n in MESSY_SCHEMA.columns
    )
    return over_messy(rows)


def _per_column(spark, folder, pick):
    """A fact of the schema beside each column's number of values in the table."""
    facts = [
        F.struct(F.lit(n).alias("column_name"), F.lit(pick(n)).alias("value"), F.count(n).alias("n_values"))
        for n in MESSY_SCHEMA.columns
    ]
    return messy(spark, folder).agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


_DTYPES = {
    "integer": "bigint", "string": "string", "float": "double", "boolean": "boolean", "ymd_datetime": "date",
    "order_status": "string", "list_of_dict": "array<map<string,string>>", "dict": "map<string,string>",
}


@query("sch_1", _messy_columns_sql(lambda n: MESSY_SCHEMA.columns[n]))
def sch_1(spark, folder):
    fields = MESSY_SCHEMA.text_struct()
    return _per_column(spark, folder, lambda n: fields[n].metadata["semantic_type"])


@query("sch_2", _messy_columns_sql(lambda n: MESSY_SCHEMA.columns[n]))
def sch_2(spark, folder):
    return _per_column(spark, folder, MESSY_SCHEMA.column_type)


@query("sch_3", _messy_columns_sql(lambda n: _DTYPES[MESSY_SCHEMA.columns[n]]))
def sch_3(spark, folder):
    return _per_column(spark, folder, MESSY_SCHEMA.column_dtype)


@query("sch_4", _messy_columns_sql(lambda n: _DTYPES[MESSY_SCHEMA.columns[n]]))
def sch_4(spark, folder):
    spec = MESSY_SCHEMA.dtype_spec(messy(spark, folder).drop("row_id"))
    return _per_column(spark, folder, spec.__getitem__)


@query("sch_5", over_messy("SELECT " + ", ".join(f"count({e}) AS {n}" for n, e in VALID_SQL.items()) + " FROM messy"))
def sch_5(spark, folder):
    return messy(spark, folder).agg(*[F.count(MESSY_SCHEMA.extractor(n)(c(n))).alias(n) for n in MESSY_SCHEMA.columns])


@query("sch_6", over_messy(" UNION ALL ".join(f"SELECT '{n}' AS column_name, count({n}) AS n_values FROM messy" for n in ["row_id", *MESSY_SCHEMA.columns])))
def sch_6(spark, folder):
    df = messy(spark, folder)
    facts = [F.struct(F.lit(n).alias("column_name"), F.count(n).alias("n_values")) for n in df.columns]
    return df.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


@query("sch_7", over_messy("SELECT count(*) AS rows_checked FROM messy"))
def sch_7(spark, folder):
    df = messy(spark, folder).drop("row_id")
    verify_column_names(list(MESSY_SCHEMA.columns), df.columns)
    return df.agg(F.count(F.lit(1)).alias("rows_checked"))


_DETECT_SQL = {
    "boolean": boolean_sql, "integer": integer_sql, "float": float_sql, "string": string_sql, "ymd_datetime": date_sql,
    "list_of_dict": records_sql, "dict": dict_sql, "order_status": lambda n: VALID_SQL["status"].replace("status", n),
}
_DETECTED = tuple(_DETECT_SQL)
_DETECT_COLUMNS = tuple(MESSY_SCHEMA.columns)


@query(
    "sch_8",
    over_messy(
        " UNION ALL ".join(
            f"SELECT '{n}' AS column_name, '{t}' AS semantic_type, coalesce(bool_and(({_DETECT_SQL[t](n)}) IS NOT NULL) FILTER (WHERE {n} IS NOT NULL), true) AS fits FROM messy"
            for n in _DETECT_COLUMNS
            for t in _DETECTED
        )
    ),
)
def sch_8(spark, folder):
    found = detect_types(messy(spark, folder).select(*_DETECT_COLUMNS), _DETECTED)
    return found.withColumnRenamed("column", "column_name")


@query(
    "sch_9",
    over_messy(
        f"SELECT row_id, {integer_sql('id')} AS id, {boolean_sql('flag')} AS flag, {date_sql('day')} AS day, {float_sql('revenue')} AS revenue FROM messy"
    ),
)
def sch_9(spark, folder):
    df = messy(spark, folder).select("row_id", "id", "flag", "day", "revenue")
    return extract_columns(df, MESSY_SCHEMA)


# -- hooks -------------------------------------------------------------------------------
_messy_query("udf_1", "flag", lambda x: F.coalesce(x == "True", F.lit(False)), "coalesce(flag = 'True', false)")


@query("udf_2", over_messy("SELECT row_id, CASE WHEN note LIKE '1-%' OR note LIKE '2-%' THEN left(note, 1) END AS value FROM messy"))
def udf_2(spark, folder):
    urgent = register_type("urgent_level", lambda x: F.when(x.rlike(r"^[12]-"), F.substring(x, 1, 1)), "string")
    return messy(spark, folder).select("row_id", urgent.extract(c("note")).alias("value"))


@query("udf_3", "SELECT event_type, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type")
def udf_3(spark, folder):
    register_analysis(
        "type_counts",
        lambda df, col: df.where(c(col).isNotNull()).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")),
        "count",
        lambda result, col: result.select(c("n").cast("double").alias("position"), c("n").cast("double").alias("value")),
    )
    return analyze(read_table(spark, folder, "events"), "value", ["type_counts"])["type_counts"]


_messy_query(
    "udf_4", "day", lambda x: scalars.is_datetime_text(x, "yyyy-MM-dd HH:mm"),
    "coalesce(try_strptime(day, '%Y-%m-%d %H:%M') IS NOT NULL, false)",
)
