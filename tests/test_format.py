import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, MapType, StringType

from gritsieve.functions.text import CENTER, LEFT, RIGHT, format_engineering, format_string, format_value

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def shown(spark, value, dtype, ddl, *args):
    df = spark.createDataFrame([(value,)], f"v {ddl}")
    return df.select(format_value(F.col("v"), dtype, *args)).first()[0].replace(" ", "_")


@pytest.mark.parametrize(
    "value, dtype, ddl, args, expected",
    [
        (None, StringType(), "string", (10, 12), "_" * 12),
        (True, BooleanType(), "boolean", (10, 12, CENTER), "____True____"),
        (False, BooleanType(), "boolean", (3, 5, CENTER), "_Fa…_"),
        (1234567890.1234567890, DoubleType(), "double", (10, 12), "_____1.235e9"),
        (-1234567890.1234567890, DoubleType(), "double", (10, 12), "____-1.235e9"),
        (-1234567890.1234567890, DoubleType(), "double", (10, 12, CENTER), "__-1.235e9__"),
        (1.234e-99, DoubleType(), "double", (10, 12), "___1.234e-99"),
        (-1.23466789e-99, DoubleType(), "double", (10, 12, CENTER), "_-1.235e-99_"),
        (LETTERS, StringType(), "string", (5, 7, CENTER), "_abcd…_"),
        ({}, MapType(StringType(), LongType()), "map<string,bigint>", (5, 7, CENTER), "___{}__"),
        ({"a": 1, "b": 2}, MapType(StringType(), LongType()), "map<string,bigint>", (5, 7, CENTER), '_{"a"…_'),
        (1234500, LongType(), "bigint", (6, 8), "__1.234…"),
        ("000123", StringType(), "string", (8, 8), "_____123"),
        ("a\nb\tc", StringType(), "string", (8, 8), "a_b_c___"),
        (0.00001, DoubleType(), "double", (10, 10), "_____1e-05"),
        (12345678.5, DoubleType(), "double", (12, 12), "__12345678.5"),
        (1e22, DoubleType(), "double", (12, 12), "_______1e+22"),
    ],
)
def test_format_value(spark, value, dtype, ddl, args, expected):
    assert shown(spark, value, dtype, ddl, *args) == expected


def test_engineering(spark):
    cases = {12345.5: "12.346e3", 1234.5: "1.234e3", 5.25: "5.25", 3.0: "3", 0.0: "0", 999.9999: "1000.000e0", 0.05: "50.000e-3", 1000.0: "1.000e3", float("nan"): "NaN", float("inf"): "Infinity"}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, v double").orderBy("i")
    assert [r[0] for r in df.select(format_engineering(F.col("v"))).collect()] == list(cases.values())
    assert spark.createDataFrame([(None,)], "v double").select(format_engineering(F.col("v"))).first()[0] == ""


@pytest.mark.parametrize("width", [6, 7, 8, 9])
@pytest.mark.parametrize("value", ["a", "ab", "abc", "abcd", "abcdefgh"])
def test_padding_matches_python(spark, value, width):
    cut = value if len(value) <= 5 else value[:4] + "…"
    df = spark.createDataFrame([(value,)], "v string")
    found = df.select(*[format_string(F.col("v"), 5, width, j) for j in (LEFT, RIGHT, CENTER)]).first()
    assert tuple(found) == (cut.ljust(width), cut.rjust(width), cut.center(width))
