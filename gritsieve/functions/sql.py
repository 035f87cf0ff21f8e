"""The extractors as SQL functions, so that raw text tables can be asked in SQL alone.

Every function is a temporary SQL function of the session whose body is an expression, so Spark
puts it into the plan of the query; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from gritsieve.functions import nested, scalars
from gritsieve.functions.text import BLANK


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + "".join(f"\\u{ord(c):04x}" if c < " " or c > "~" else {"\\": "\\\\", "'": "\\'"}.get(c, c) for c in text) + "'"


def _replaced(s: str, pairs) -> str:
    for pattern, replacement in pairs:
        s = f"regexp_replace({s}, {quoted(pattern)}, {quoted(replacement)})"
    return s


def _matched(pattern: str, group: int, kind: str) -> str:
    return f"try_cast(regexp_extract(strip_text(s), {quoted(pattern)}, {group}) AS {kind})"


def _parsed(schema: str, opening: str) -> str:
    """The value of a text in JSON, else in Python's notation, else with its inner apostrophes repaired."""

    def one(t: str) -> str:
        wrapped = f"from_json(concat('{{\"v\":[', {t}, '],\"e\":1}}'), {quoted(schema)})"
        return f"get(filter(array({wrapped}), w -> w.e = 1 AND size(w.v) = 1), 0).v[0]"

    s = "strip_text(s)"
    repaired = f"CASE WHEN {s} RLIKE {quoted(chr(40) + '?U)' + chr(92) + 'w' + chr(39) + chr(92) + 'w')} THEN {one(f'literal_to_json(repair_apostrophes({s}))')} END"
    return f"CASE WHEN {s} RLIKE {quoted('^' + opening)} THEN coalesce({one(s)}, {one(f'literal_to_json({s})')}, {repaired}) END"


# A map's repeated keys: the last value, at the place of the first.
_LAST = (
    "CASE WHEN size(array_distinct(map_keys(m))) < size(m) THEN map_from_arrays(array_distinct(map_keys(m)), "
    "transform(array_distinct(map_keys(m)), k -> element_at(filter(map_entries(m), e -> e.key = k), -1).value)) ELSE m END"
)
_LABELS = ", ".join(quoted(label) for label in scalars.STATUS_LABELS)
_RECORDS = "array<map<string,string>>"


def definitions() -> dict[str, str]:
    """Signature and body of every function, helpers first."""
    day = _matched(scalars.YMD_TEXT, 0, "DATE")
    records = _parsed(nested.RECORDS_SCHEMA, r"\[")
    return {
        "strip_text(s STRING) RETURNS STRING": f"btrim(s, {quoted(BLANK)})",
        "literal_to_json(s STRING) RETURNS STRING": _replaced("s", nested.LITERAL_REWRITES),
        "repair_apostrophes(s STRING) RETURNS STRING": _replaced("s", [(nested.INNER_APOSTROPHE, r"\\u0027")]),
        "extract_string(s STRING) RETURNS STRING": "nullif(strip_text(s), '')",
        "extract_integer(s STRING) RETURNS BIGINT": _matched(scalars.INTEGER_TEXT, 1, "BIGINT"),
        "extract_float(s STRING) RETURNS DOUBLE": _matched(scalars.FLOAT_TEXT, 0, "DOUBLE"),
        "to_amount(s STRING) RETURNS DECIMAL(38,6)": "try_cast(s AS DECIMAL(38,6))",
        "extract_boolean(s STRING) RETURNS BOOLEAN": "CASE lower(strip_text(s)) WHEN 'true' THEN true WHEN 'false' THEN false END",
        "extract_ymd_datetime(s STRING) RETURNS DATE": f"CASE WHEN {day} BETWEEN DATE'{scalars.FIRST_DAY}' AND DATE'{scalars.LAST_DAY}' THEN {day} END",
        "extract_status_category(s STRING) RETURNS STRING": f"CASE WHEN strip_text(s) IN ({_LABELS}) THEN strip_text(s) END",
        "last_of_keys(m MAP<STRING, STRING>) RETURNS MAP<STRING, STRING>": _LAST,
        "extract_dict(s STRING) RETURNS MAP<STRING, STRING>": f"last_of_keys({_parsed(nested.DICT_SCHEMA, chr(92) + '{')})",
        f"record_maps(s STRING) RETURNS {_RECORDS}": f"get(filter(array({records}), r -> size(r) > 0 AND forall(r, x -> x IS NOT NULL)), 0)",
        f"extract_list_of_dict(s STRING) RETURNS {_RECORDS}": f"transform(record_maps(s), m -> {_LAST})",
        "list_elements(s STRING) RETURNS ARRAY<STRING>": _parsed(nested.LIST_SCHEMA, r"\["),
        "extract_object(s STRING) RETURNS STRING": _parsed(nested.TEXT_SCHEMA, r"[\[{]"),
        "list_items(s STRING) RETURNS TABLE(item STRING)": "SELECT explode(v) AS item FROM (SELECT list_elements(s) AS v)",
        "list_records(s STRING) RETURNS TABLE(record MAP<STRING, STRING>)": "SELECT explode(v) AS record FROM (SELECT extract_list_of_dict(s) AS v)",
    }


def register_functions(spark: SparkSession) -> None:
    """Create or replace the functions in this session: one for each semantic type, list and record table functions, the number cast."""
    for signature, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
