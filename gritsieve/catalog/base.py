"""Registration of the catalogue's queries, and the all-text table they share.

The given tables are clean, so the catalogue derives a messy one from ``orders``: every
column as text, with the defects that a hand-kept table has (padded, mistyped, missing and
half-quoted cells). The expressions below are valid in Spark and in ANSI SQL alike.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritsieve.schema import SemanticSchema, register_type
from gritsieve.functions.scalars import extract_category
from gritsieve.sources.files import read_table, spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its check."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


_TEXT_KEY = "CAST(o_orderkey AS STRING)"
_CENTS = "CAST(CAST(ROUND(o_totalprice * 100) AS BIGINT) AS STRING)"
_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_QUOTE = "chr(39)"


def _cases(modulus: int, cases: dict[int, str], otherwise: str) -> str:
    whens = " ".join(f"WHEN o_orderkey % {modulus} = {n} THEN {e}" for n, e in cases.items())
    return f"CASE {whens} ELSE {otherwise} END"


def _quoted(text: str) -> str:
    """SQL concatenation of a text in which ` stands for an apostrophe and {..} for an expression."""
    parts, rest = [], text
    while rest:
        if rest.startswith("`"):
            parts.append(_QUOTE)
            rest = rest[1:]
        elif rest.startswith("<<"):
            end = rest.index(">>")
            parts.append(rest[2:end])
            rest = rest[end + 2 :]
        else:
            cut = min([i for i in (rest.find("`"), rest.find("<<")) if i >= 0] or [len(rest)])
            parts.append(f"'{rest[:cut]}'")
            rest = rest[cut:]
    return f"concat({', '.join(parts)})"


_RECORDS = (
    "[{`id`: <<CAST(o_custkey % 20 AS STRING)>>, `name`: `<<o_orderpriority>>`}, "
    "{`id`: <<CAST(20 + o_custkey % 7 AS STRING)>>, `name`: `<<o_orderstatus>>`}]"
)

MESSY = {
    "row_id": "o_orderkey",
    "id": _cases(
        11,
        {
            3: f"concat({_TEXT_KEY}, '.00')",
            5: f"concat('  ', {_TEXT_KEY}, ' ')",
            7: f"concat('x', {_TEXT_KEY})",
            8: "NULL",
            9: f"concat({_TEXT_KEY}, '.50')",
        },
        _TEXT_KEY,
    ),
    "title": _cases(7, {1: "'   '", 2: f"concat('Title ', {_TEXT_KEY}, chr(10))"}, "concat('Title ', CAST(o_custkey AS STRING))"),
    "revenue": _cases(
        9,
        {
            1: f"concat({_CENTS}, 'e-2')",
            2: f"concat('+', {_CENTS})",
            3: "'nan'",
            4: f"concat('-', {_CENTS}, '.5')",
            5: f"concat({_CENTS}, '.1.2')",
            6: "'  '",
            7: f"concat({_CENTS}, '.25')",
        },
        _CENTS,
    ),
    "budget": _cases(13, {1: "'n/a'", 2: "'/poster.jpg'"}, "CAST((o_orderkey * 7919) % 40000000 + 1 AS STRING)"),
    "flag": _cases(5, {0: "'True'", 1: "'False'", 2: "' true '", 3: "'Falsee'"}, "NULL"),
    "day": _cases(6, {1: f"concat({_DAY}, ' 00:00')", 2: "'2023-02-30'", 3: f"concat(' ', {_DAY}, ' ')", 4: "'24-12-01'"}, _DAY),
    "status": _cases(7, {1: "lower(o_orderstatus)", 2: "concat(' ', o_orderstatus, ' ')", 3: "'unknown'"}, "o_orderstatus"),
    "items": _cases(
        10,
        {
            1: "'[]'",
            2: "'False'",
            3: _quoted("[{`id`: 16, `name`: `le`Show<<CAST(o_custkey % 5 AS STRING)>>`}]"),
            4: _quoted('[{"id": 3, "name": "<<o_orderpriority>>"}]'),
            5: _quoted("[{`id`: 4, `name`: None}, {`id`: 5, `name`: `Tor`}, {`id`: 6, `name`: `Uni`}]"),
            6: _quoted("[{`a`: 1}, 3]"),
            7: _quoted("[{`id`: 7, `name`: `Lietuvi<<chr(92)>>x9akai`}]"),
            8: "NULL",
        },
        _quoted(_RECORDS),
    ),
    "info": _cases(
        6,
        {
            0: _quoted("{`id`: <<CAST(o_custkey AS STRING)>>, `name`: `Set <<CAST(o_custkey % 50 AS STRING)>>`}"),
            1: _quoted('{"id": 1, "name": "<<o_orderstatus>>"}'),
            2: "'[]'",
            3: "'0.065736'",
            4: _quoted("{`name`: `le`Set`, `id`: 3}"),
        },
        "'{}'",
    ),
    "homepage": _cases(5, {0: "concat('http://', o_orderpriority)", 1: "''"}, "NULL"),
    "note": _cases(10, {0: "o_orderpriority"}, "NULL"),
    "blank": "CAST(NULL AS STRING)",
}

register_type("order_status", lambda c: extract_category(c, ("F", "O", "P")), "string")

MESSY_SCHEMA = SemanticSchema(
    {
        "id": "integer",
        "title": "string",
        "revenue": "float",
        "budget": "integer",
        "flag": "boolean",
        "day": "ymd_datetime",
        "status": "order_status",
        "items": "list_of_dict",
        "info": "dict",
        "homepage": "string",
        "note": "string",
        "blank": "string",
    }
)

MESSY_CTE = f"messy AS (SELECT {', '.join(f'{e} AS {n}' for n, e in MESSY.items())} FROM orders)"


def messy(spark: SparkSession, folder: str) -> DataFrame:
    """Derived in parallel; the second spread ends the derivation, so queries meet plain columns."""
    orders = spread(read_table(spark, folder, "orders"), "o_orderkey")
    return spread(orders.selectExpr(*[f"{e} AS {n}" for n, e in MESSY.items()]), "row_id")


def tagged(parts: dict[str, DataFrame]) -> DataFrame:
    """Tables of different columns as one, each row with its part's name."""
    named = [df.select(F.lit(name).alias("part"), "*") for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def over_messy(sql: str) -> str:
    """Put the messy table in front of a check."""
    return f"WITH {MESSY_CTE}{',' if sql.lstrip().startswith(',') else ''} {sql.lstrip().lstrip(',')}"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder all executors share, under spark.checkpoint.dir; local masters may use a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/gritsieve-{spark.sparkContext.applicationId}-{len(QUERIES)}-{next(_COUNTER)}"
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="gritsieve-") + "/data"
    raise ValueError("set spark.checkpoint.dir to a folder all executors share")


_COUNTER = iter(range(10**9))

# What text values look like after the extractors, in SQL.
def strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def string_sql(c: str) -> str:
    return f"nullif({strip_sql(c)}, '')"


def integer_sql(c: str) -> str:
    return rf"try_cast(regexp_extract({strip_sql(c)}, '^([0-9]+)(\.0+)?$', 1) AS BIGINT)"


def float_sql(c: str) -> str:
    s = strip_sql(c)
    return rf"CASE WHEN regexp_full_match({s}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast({s} AS DOUBLE) END"


def boolean_sql(c: str) -> str:
    s = f"lower({strip_sql(c)})"
    return f"CASE {s} WHEN 'true' THEN true WHEN 'false' THEN false END"


def date_sql(c: str) -> str:
    s = strip_sql(c)
    return f"CASE WHEN regexp_full_match({s}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast({s} AS DATE) END"


def json_sql(c: str) -> str:
    """The text in JSON notation; null if it is no valid JSON afterwards."""
    s = rf"regexp_replace({c}, '([A-Za-z0-9_])''([A-Za-z0-9_])', '\1\\u0027\2', 'g')"
    s = f"replace(replace(replace({s}, '''', '\"'), 'None', 'null'), '\\x9a', '\\u009a')"
    return f"CASE WHEN json_valid({s}) THEN {s} END"


def records_sql(c: str) -> str:
    """JSON text of a non-empty list of objects, else null."""
    j = json_sql(c)
    return (
        f"CASE WHEN json_type({j}) = 'ARRAY' AND json_array_length({j}) > 0 AND "
        f"list_bool_and(list_transform(json_extract({j}, '$[*]'), lambda x: json_type(x) = 'OBJECT')) THEN {j} END"
    )


def dict_sql(c: str) -> str:
    j = json_sql(c)
    return f"CASE WHEN json_type({j}) = 'OBJECT' THEN {j} END"


VALID_SQL = {
    "id": integer_sql("id"),
    "title": string_sql("title"),
    "revenue": float_sql("revenue"),
    "budget": integer_sql("budget"),
    "flag": boolean_sql("flag"),
    "day": date_sql("day"),
    "status": f"CASE WHEN {strip_sql('status')} IN ('F', 'O', 'P') THEN {strip_sql('status')} END",
    "items": records_sql("items"),
    "info": dict_sql("info"),
    "homepage": string_sql("homepage"),
    "note": string_sql("note"),
    "blank": string_sql("blank"),
}
