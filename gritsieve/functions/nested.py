"""Dictionary and record-list texts, in JSON or Python-literal notation.

The text is placed inside a wrapper object and parsed once with ``from_json``: the wrapper's
second field is present only if the text is one complete value, so trailing junk, a lone
object instead of a list, or half a value never pass as valid.
"""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from gritsieve.functions.binding import bind, only_if
from gritsieve.functions.text import strip

TEXT_SCHEMA = "struct<v:array<string>,e:int>"
RECORDS_SCHEMA = "struct<v:array<array<map<string,string>>>,e:int>"
DICT_SCHEMA = "struct<v:array<map<string,string>>,e:int>"
LIST_SCHEMA = "struct<v:array<array<string>>,e:int>"


def _outside_quotes(pattern: str, replacement: str, sign: str) -> tuple[str, str]:
    """Pattern and replacement that leave quoted text alone; ``$2`` is the pattern's first group.

    Only texts in which a plain search finds ``sign``, without which the pattern cannot match, are walked.
    """
    quoted = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
    walked = rf"""(?:\A(?=(?s:.*?){sign})|(?!\A)\G)"""
    return rf"""{walked}((?:{quoted}|(?!{pattern})[^'"])*+){pattern}""", "$1" + replacement


# From Python's notation of lists and dicts to JSON, step by step.
LITERAL_REWRITES = (
    *(_outside_quotes(rf"\b{word}\b", token, word) for word, token in (("None", "null"), ("True", "true"), ("False", "false"))),
    _outside_quotes(r",\s*(?=[}\]])", "", r",\s*[}\]]"),
    _outside_quotes(r"(?<=[{,])\s*(-?\d+(?:\.\d+)?)\s*(?=:)", '"$2"', r"\d\s*:"),
    (r"(?<=[^\s\[{,:\\])''(?=[^\s,:\]}])", ""),
    (r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2"),
)
INNER_APOSTROPHE = r"(?U)'(?=\w)(?<=\w')"
# A word of Python's outside quotes; longer texts are not walked for it.
BARE_WORD = r"""\A(?=(?s:.*?)(?:None|True|False))(?:[^'"NTF]++|'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+(?:None|True|False)"""
LONGEST_WALK = 4096


def literal_to_json(c: Column) -> Column:
    """Python's notation of lists and dicts as JSON: None, True, False, number keys, a last comma, joined texts, ``\\xNN``."""
    for pattern, replacement in LITERAL_REWRITES:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def escape_inner_apostrophes(c: Column) -> Column:
    """Apostrophes between two word characters are part of a name, not a quote.

    Text that needs no repair keeps its meaning: a quoting apostrophe has punctuation or a
    blank on one side, and within double quotes the escape stands for the same character.
    """
    return F.regexp_replace(c, INNER_APOSTROPHE, r"\\u0027")


def _parse_one(c: Column, schema: str) -> Column:
    wrapped = F.from_json(F.concat(F.lit('{"v":['), c, F.lit('],"e":1}')), schema)
    return only_if(wrapped, lambda w: (w["e"] == 1) & (F.size(w["v"]) == 1))["v"][0]


def _last_wins(m: Column) -> Column:
    """A map without repeated keys: each key's last value, at the place of its first."""
    keys = F.array_distinct(F.map_keys(m))
    value = lambda k: F.element_at(F.filter(F.map_entries(m), lambda e: e["key"] == k), -1)["value"]
    return F.when(F.size(keys) < F.size(m), F.map_from_arrays(keys, F.transform(keys, value))).otherwise(m)


def _no_json(c: Column) -> Column:
    """Is a text surely no JSON? A refused parse throws, which costs ten times an accepted one.

    True of an unquoted None, True or False, of an escape ``\\x``, and, where apostrophes are the only quotes,
    of one between two word characters: JSON has a sign or a blank beside each quote.
    """
    return (
        (c.contains("\\x") & c.rlike(r"(?<!\\)(?:\\\\)*\\x"))
        | (~c.contains('"') & c.rlike(r"(?U)\w'\w"))
        | ((F.length(c) <= LONGEST_WALK) & c.rlike(BARE_WORD))
    )


def _parse(c: Column, opening: str, schema: str) -> Column:
    """Parse the stripped text as it is, else in Python's notation, else with its inner apostrophes repaired.

    What Python's notation leaves as it is, and what surely is no JSON, is not parsed.
    """

    def read(s: Column) -> Column:
        plain = F.when(~_no_json(s), _parse_one(s, schema))
        told = bind(literal_to_json(s), lambda j: F.when((j != s) & ~_no_json(j), _parse_one(j, schema)))
        repaired = F.when(s.rlike(r"(?U)\w'\w"), _parse_one(literal_to_json(escape_inner_apostrophes(s)), schema))
        return F.when(s.rlike(rf"^{opening}"), F.coalesce(plain, told, repaired))

    return bind(strip(c), read)


@F.pandas_udf(StringType())
def _literal_json(texts: pd.Series) -> pd.Series:
    """JSON text of a Python list or dict literal; null for anything else."""

    def convert(text):
        if text is None:
            return None
        try:
            value = ast.literal_eval(text)
            return json.dumps(value, ensure_ascii=False) if isinstance(value, (list, dict)) else None
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return texts.map(convert)


def extract_object(c: Column, python_fallback: bool = False) -> Column:
    """Canonical JSON text of a list or dict, null for scalars and unreadable text.

    ``python_fallback`` also reads literals JSON has no notation for (trailing commas, octal
    escapes); only texts the native parse refused are handed to Python.
    """
    native = _parse(c, r"[\[{]", TEXT_SCHEMA)
    if not python_fallback:
        return native
    s = strip(c)
    refused = F.when(native.isNull() & s.rlike(r"^[\[{]"), s)
    return F.coalesce(native, _literal_json(refused))


def object_kind(c: Column) -> Column:
    """'array', 'object' or null."""
    first = F.substring(extract_object(c), 1, 1)
    return F.when(first == "[", "array").when(first == "{", "object")


def to_variant(c: Column) -> Column:
    return F.try_parse_json(extract_object(c))


def extract_dict(c: Column, python_fallback: bool = False) -> Column:
    """map<string,string>; values that are not text keep their JSON text."""
    if python_fallback:
        c = extract_object(c, True)
    return bind(_parse(c, r"\{", DICT_SCHEMA), _last_wins)


def is_dict(c: Column) -> Column:
    return extract_dict(c).isNotNull()


def extract_records(c: Column, python_fallback: bool = False) -> Column:
    """array<map<string,string>> of a non-empty list whose elements are all dicts."""
    if python_fallback:
        c = extract_object(c, True)
    rows = only_if(
        _parse(c, r"\[", RECORDS_SCHEMA), lambda rows: (F.size(rows) > 0) & F.forall(rows, lambda r: r.isNotNull())
    )
    return F.transform(rows, _last_wins)


def is_records(c: Column) -> Column:
    return extract_records(c).isNotNull()


def typed_records(c: Column, fields: dict[str, str]) -> Column:
    """array<struct> with the named fields; a field that does not cast is null."""
    return F.transform(
        extract_records(c),
        lambda r: F.struct(*[r[name].try_cast(kind).alias(name) for name, kind in fields.items()]),
    )


def list_elements(c: Column) -> Column:
    """array<string> of a list's elements as canonical JSON text; the empty list stays empty."""
    return _parse(c, r"\[", LIST_SCHEMA)


def list_length(c: Column) -> Column:
    return F.size(list_elements(c))


def to_json_text(c: Column) -> Column:
    return F.to_json(c)
