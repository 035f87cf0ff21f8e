"""Numbers, booleans, dates and categories read from text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from gritsieve.functions.text import strip

# Accepted texts, as patterns.
INTEGER_TEXT = r"^([0-9]+)(?:\.0+)?\z"
SIGNED_INTEGER_TEXT = r"^([+-]?[0-9]+)(?:\.0+)?\z"
FLOAT_TEXT = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))\z"
YMD_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
YMD_FORMAT = "yyyy-MM-dd"
FIRST_DAY, LAST_DAY = "1677-09-22", "2262-04-11"
STATUS_LABELS = ("Rumored", "Planned", "In Production", "Post Production", "Released", "Canceled")


def _matched(c: Column, pattern: str, group: int = 0) -> Column:
    """What a whole-text pattern finds, else null; a cast of ``regexp_extract``'s empty text would throw for every such cell."""
    return F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(0))


def extract_integer(c: Column, signed: bool = False) -> Column:
    """Digits, or digits followed by a zero fraction; anything else is null."""
    return _matched(strip(c), SIGNED_INTEGER_TEXT if signed else INTEGER_TEXT, 1).try_cast("bigint")


def is_integer(c: Column) -> Column:
    return extract_integer(c).isNotNull()


def extract_float(c: Column) -> Column:
    """Decimal, exponent and infinity texts; the text ``nan`` is a missing value."""
    return _matched(strip(c), FLOAT_TEXT).try_cast("double")


def is_float(c: Column) -> Column:
    return extract_float(c).isNotNull()


def to_numeric(c: Column, precision: int = 38, scale: int = 6) -> Column:
    return c.try_cast(f"decimal({precision},{scale})")


def extract_boolean(c: Column) -> Column:
    word = F.lower(strip(c))
    return F.when(word == "true", F.lit(True)).when(word == "false", F.lit(False))


def is_boolean(c: Column, exact: bool = False) -> Column:
    """``exact`` leaves surrounding blanks in place, so padded words do not count."""
    if exact:
        return F.coalesce(F.lower(c).isin("true", "false"), F.lit(False))
    return extract_boolean(c).isNotNull()


def extract_date(c: Column) -> Column:
    day = _matched(strip(c), YMD_TEXT).try_cast("date")
    return F.when(day.between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date")), day)


def is_date(c: Column) -> Column:
    return extract_date(c).isNotNull()


def is_datetime_text(c: Column, pattern: str = YMD_FORMAT) -> Column:
    """Does the text match a strict datetime pattern?"""
    return F.try_to_timestamp(c, F.lit(pattern)).isNotNull()


def release_month(c: Column) -> Column:
    return F.month(extract_date(c))


def extract_category(c: Column, labels: Sequence[str] = STATUS_LABELS) -> Column:
    s = strip(c)
    return F.when(s.isin(*labels), s)


def is_category(c: Column, labels: Sequence[str] = STATUS_LABELS) -> Column:
    return extract_category(c, labels).isNotNull()


def drop_nan(c: Column) -> Column:
    """NaN becomes null, so both kinds of missing value are one."""
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


def normal_pdf(x: Column, mean: Column | float, sd: Column | float, scale: Column | float = 1.0) -> Column:
    mean, sd, scale = (v if isinstance(v, Column) else F.lit(float(v)) for v in (mean, sd, scale))
    z = (x - mean) / sd
    return scale * F.exp(-0.5 * z * z) / (sd * F.sqrt(2 * F.pi()))
