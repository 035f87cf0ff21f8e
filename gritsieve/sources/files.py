"""Reading and writing files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType, VariantType

from gritsieve.functions.scalars import drop_nan
from gritsieve.sources.split_csv import read_split_csv

# Cell texts that mean "missing".
NA_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def csv_column_names(spark: SparkSession, path: str) -> list[str]:
    """Header names; quoted commas stay inside a name."""
    return spark.read.options(**CSV_OPTIONS).csv(path).columns


def read_text_csv(
    spark: SparkSession, path: str, schema: StructType | None = None, multi_line: bool = True, number: str | None = None, whole_files: bool = False
) -> DataFrame:
    """Every column as text, missing-value texts as null; files are cut into ranges that many tasks read.

    Cells may hold line breaks; ``multi_line=False`` saves the extra scan where none does.
    ``number`` adds a column with the row's place in the files. ``whole_files`` reads each file by one
    task with Spark's own reader.
    """
    if schema is None:
        schema = StructType()
        for name in csv_column_names(spark, path):
            schema = schema.add(name, StringType())
    if number or (multi_line and not whole_files):
        df = read_split_csv(spark, path, schema, {"quote": '"', "escape": '"'}, number)
    else:
        df = spark.read.options(**{**CSV_OPTIONS, "multiLine": multi_line}).schema(schema).csv(path)
    numbers = [F.col(number)] if number else []
    return df.select(
        *[F.when(~F.col(f.name).isin(*NA_TEXTS), F.col(f.name)).alias(f.name, metadata=f.metadata) for f in schema], *numbers
    )


def read_inferred_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Column types inferred from the values; NaN read as null."""
    options = {**CSV_OPTIONS, "multiLine": multi_line, "inferSchema": True}
    df = spark.read.options(**options).csv(path)
    kinds = dict(df.dtypes)
    return df.select(*[drop_nan(F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def text_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_numbered_table(spark: SparkSession, folder: str, name: str, number: str) -> DataFrame:
    """A Parquet table with each row's place in its files, in the order of their paths.

    One scan counts the rows of each file, a running sum over the files, a row each, says how
    many lie before it; the place inside a file is the reader's, so numbers do not depend on splits.
    """
    df = read_table(spark, folder, name)
    meta = F.col("_metadata")
    sizes = df.groupBy(meta["file_path"].alias("__path")).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__path", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    rows = df.select("*", meta["file_path"].alias("__path"), meta["row_index"].alias("__at"))
    return rows.join(offsets, "__path").select(*df.columns, (F.col("__before") + F.col("__at")).alias(number))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread rows by a key over as many tasks as a shuffle has.

    For costly work per row on a table stored in few row groups, which Spark cannot split.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Header CSV, nulls empty; nested columns become JSON text."""
    nested = (ArrayType, MapType, StructType, VariantType)
    flat = df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
    )
    flat.write.mode(mode).options(header=True, quote='"', escape='"', emptyValue="", nullValue="").csv(path)


def write_report(tables: dict[str, DataFrame], folder: str, mode: str = "error") -> None:
    """One parquet table per report part."""
    for name, table in tables.items():
        table.write.mode(mode).parquet(f"{folder.rstrip('/')}/{name}")


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly n rows (or all) in a repeatable random order of the key columns."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    return df.orderBy(digest, *keys).limit(n)
