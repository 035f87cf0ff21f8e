"""Text columns: stripping, extraction, display formatting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegralType,
    MapType,
    StringType,
    StructType,
    VariantType,
)

from gritsieve.functions.binding import bind

# The characters that count as blank; the mark that ends a shortened text.
BLANK = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
ELLIPSIS = "…"

LEFT, CENTER, RIGHT = "left", "center", "right"


def strip(c: Column) -> Column:
    """Remove leading and trailing blanks, Unicode ones included."""
    return F.btrim(c, F.lit(BLANK))


def extract_string(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def is_string(c: Column) -> Column:
    return extract_string(c).isNotNull()


def replace_text(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def same_text(c: Column, word: str) -> Column:
    """Case-insensitive equality."""
    return F.lower(c) == F.lit(word.lower())


def _pad(c: Column, width: int, justify: str) -> Column:
    room = F.greatest(F.length(c), F.lit(width))
    if justify == LEFT:
        return F.rpad(c, room, F.lit(" "))
    if justify == RIGHT:
        return F.lpad(c, room, F.lit(" "))
    gap = room - F.length(c)
    # an odd gap puts the spare blank on the left only when the width is odd too
    before = F.floor(gap / 2) + gap.bitwiseAND(F.lit(width)).bitwiseAND(F.lit(1))
    return F.rpad(F.concat(F.repeat(F.lit(" "), before.cast("int")), c), room, F.lit(" "))


def format_string(c: Column, size: int, width: int, justify: str = LEFT) -> Column:
    """Cut a text to ``size`` characters, ending in an ellipsis, and pad it to ``width``."""

    def shape(t: Column) -> Column:
        flat = F.translate(t, "\n\t", "  ")
        cut = F.concat(F.substring(flat, 1, size - 1), F.lit(ELLIPSIS))
        padded = bind(F.when(F.length(flat) > size, cut).otherwise(flat), lambda short: _pad(short, width, justify))
        return F.when(is_string(t), padded).otherwise(F.lit(" " * width))

    return bind(c, shape)


def format_engineering(c: Column) -> Column:
    """``1.235e9`` form: three decimals, ties to even, and an exponent divisible by three.

    Numbers of exponent zero keep all their digits; null becomes an empty text.
    """
    x = c.cast("double")
    science = F.format_string("%.16e", x)
    power = F.substring_index(science, "e", -1).try_cast("int")
    extra = F.pmod(power, F.lit(3))
    factor = F.when(extra == 0, 1).when(extra == 1, 10).otherwise(100).cast("decimal(3,0)")
    mantissa = F.substring_index(science, "e", 1).try_cast("decimal(20,16)") * factor
    shown = F.concat(F.bround(mantissa, 3).cast("string"), F.lit("e"), (power - extra).cast("string"))
    special = F.when(F.isnan(x), F.lit("NaN")).otherwise(F.regexp_replace(x.cast("string"), r"\.0\z", ""))
    # no exponent at all: NaN and the infinities
    return F.when(x.isNull(), F.lit("")).when((x == 0) | (F.coalesce(power, F.lit(0)) == 0), special).otherwise(shown)


def number_text(c: Column, dtype: DataType) -> Column:
    """A number's usual text: plain digits from 1e-4 up to 1e16, exponent form outside."""
    raw = c.cast("string")
    if not isinstance(dtype, (FloatType, DoubleType)):
        return raw
    size = F.abs(c)
    digits = F.regexp_replace(raw.try_cast("decimal(38,20)").cast("string"), r"0+\z", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), r"\.0\z", "")
    power = F.substring_index(raw, "E", -1).try_cast("int")
    sign = F.when(power < 0, F.lit("-")).otherwise(F.lit("+"))
    science = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    return (
        F.when(F.isnan(c) | (size == float("inf")), F.regexp_replace(F.lower(raw), "infinity", "inf"))
        .when(~raw.contains("E"), raw)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(science)
    )


def format_value(c: Column, dtype: DataType, size: int, width: int, justify: str | None = None) -> Column:
    """Display text of any column; ``dtype`` picks the form when the plan is built."""
    if isinstance(dtype, BooleanType):
        return format_string(F.initcap(c.cast("string")), size, width, justify or LEFT)
    if isinstance(dtype, (IntegralType, FloatType, DoubleType, DecimalType)):
        usual = number_text(c, dtype)
        shown = F.when(F.length(usual) > size, format_engineering(c)).otherwise(usual)
        return format_string(shown, size, width, justify or RIGHT)
    if isinstance(dtype, StringType):
        digits = F.coalesce(F.regexp_replace(c, r"^0+(?=\d)", ""), F.lit(""))
        number = F.when(F.length(digits) > size, format_engineering(digits.try_cast("double"))).otherwise(digits)
        return F.when(
            c.rlike(r"^\d+\z"), format_string(number, size, width, justify or RIGHT)
        ).otherwise(format_string(c, size, width, justify or LEFT))
    if isinstance(dtype, (MapType, ArrayType, StructType, VariantType)):
        return format_string(F.to_json(c), size, width, justify or RIGHT)
    return format_string(c.cast("string"), size, width, justify or RIGHT)
