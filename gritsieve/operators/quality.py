"""Validation, rejects and column or row removal."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from gritsieve.operators.aggregates import all_valid, frequencies, null_counts
from gritsieve.schema import SemanticSchema, extract_columns, semantic_type, semantic_types
from gritsieve.session import ensure_checkpoint_dir


def _long_rejects(df: DataFrame, schema: SemanticSchema, *keep) -> DataFrame:
    """One row per non-null cell that fails its column's type."""
    cells = []
    for c in schema.known(df):
        kind = schema.column_type(c)
        bad = F.col(c).isNotNull() & ~semantic_type(kind).is_valid(F.col(c))
        cell = F.struct(F.lit(c).alias("column"), F.lit(kind).alias("semantic_type"), F.col(c).alias("value"))
        cells.append(F.when(bad, cell))
    if not cells:
        cells = [F.lit(None).cast("struct<column:string,semantic_type:string,value:string>")]
    return df.select(*keep, F.explode(F.array(*cells)).alias("cell")).where("cell is not null")


def cell_rejects(df: DataFrame, schema: SemanticSchema, row_id: str) -> DataFrame:
    """One row per invalid cell: (row_id, column, semantic_type, value)."""
    return _long_rejects(df, schema, F.col(row_id).alias("row_id")).select("row_id", "cell.*")


def _is_bad(schema: SemanticSchema, columns: Sequence[str]) -> Column:
    """Does ``value`` fail the type of the column named in ``column``?"""
    bad = F.lit(False)
    for kind in sorted({schema.columns[c] for c in columns if c in schema.columns}):
        own = F.col("column").isin(*[c for c in columns if schema.columns.get(c) == kind])
        bad = F.when(own, ~semantic_type(kind).is_valid(F.col("value"))).otherwise(bad)
    return bad


def _kind(schema: SemanticSchema, columns: Sequence[str]) -> Column:
    """The type of the column named in ``column``; null if it has none."""
    kind = F.lit(None).cast("string")
    for c in columns:
        if c in schema.columns:
            kind = F.when(F.col("column") == c, F.lit(schema.columns[c])).otherwise(kind)
    return kind


def cell_counts(df: DataFrame, schema: SemanticSchema) -> DataFrame:
    """(column, semantic_type, value, n_rows, is_bad): the distinct bad values and, under null, the good cells of each column.

    Rows are read once and each distinct value is judged once; ``is_bad`` is an aggregate, so
    that no filter on it moves that test back to the cells.
    """
    cells = [F.col(c) if c in schema.columns else F.when(F.col(c).isNotNull(), F.lit("")).alias(c) for c in df.columns]
    counts = frequencies(df.select(*cells), df.columns)
    bad = F.when(_is_bad(schema, df.columns), F.col("value"))
    judged = counts.select("column", _kind(schema, df.columns).alias("semantic_type"), bad.alias("value"), "n")
    is_bad = F.some(F.col("value").isNotNull())
    return judged.groupBy("column", "semantic_type", "value").agg(F.sum("n").alias("n_rows"), is_bad.alias("is_bad"))


def _rejects_of(cells: DataFrame) -> DataFrame:
    return cells.where("is_bad").drop("is_bad")


def _summary_of(cells: DataFrame, columns: Sequence[str], schema: SemanticSchema) -> DataFrame:
    names = cells.sparkSession.createDataFrame([(c, schema.columns.get(c)) for c in columns], "column string, semantic_type string")
    seen = cells.groupBy("column").agg(
        F.sum("n_rows").alias("n_values"),
        F.sum(F.when(F.col("is_bad"), F.col("n_rows"))).alias("n_invalid"),
        F.count_if("is_bad").alias("n_distinct_bad"),
    )
    status = (
        F.when(F.col("semantic_type").isNull(), "unregistered")
        .when(F.col("n_invalid") > 0, "invalid")
        .otherwise("valid")
    )
    numbers = [F.coalesce(n, F.lit(0)).alias(n) for n in ("n_values", "n_invalid", "n_distinct_bad")]
    return names.join(seen, "column", "left").select("column", "semantic_type", status.alias("status"), *numbers)


def distinct_rejects(df: DataFrame, schema: SemanticSchema) -> DataFrame:
    """Each distinct bad value of each column with its number of rows."""
    return _rejects_of(cell_counts(df, schema))


def validation_summary(df: DataFrame, schema: SemanticSchema) -> DataFrame:
    """Per column: status, and numbers of non-null, invalid and distinct bad cells.

    Every column has exactly one status: 'valid', 'invalid' or 'unregistered'. Rows are read
    once for all numbers.
    """
    return _summary_of(cell_counts(df, schema), df.columns, schema)


def null_out_invalid(df: DataFrame, schema: SemanticSchema, row_id: str) -> tuple[DataFrame, DataFrame]:
    """The typed frame (invalid cells null) and the table of rejected cells."""
    columns = [c for c in schema.known(df) if c != row_id]
    return extract_columns(df, schema, columns), cell_rejects(df.select(row_id, *columns), schema, row_id)


def keep_valid(df: DataFrame, col: str, kind: str) -> DataFrame:
    """Rows whose cell is a valid value of the type."""
    return df.where(semantic_type(kind).is_valid(F.col(col)))


def error_report(df: DataFrame, schema: SemanticSchema, run_id: str | None = None) -> dict[str, DataFrame]:
    """Summary and distinct rejects, stamped with the run's id and start time; both from one checkpointed count of the cells."""
    ensure_checkpoint_dir(df.sparkSession)
    run_id = run_id or uuid.uuid4().hex
    stamp = [F.lit(run_id).alias("run_id"), F.current_timestamp().alias("started_at")]
    cells = cell_counts(df, schema).checkpoint()
    return {
        "summary": _summary_of(cells, df.columns, schema).select(*stamp, "*"),
        "rejects": _rejects_of(cells).select(*stamp, "*"),
    }


def detect_types(
    df: DataFrame, types: Sequence[str] | None = None, skip: Sequence[str] = ()
) -> DataFrame:
    """(column, semantic_type, fits): which types all of a column's values have, in one pass.

    Each distinct text of a column is tested once; columns that are no text are tested row by row.
    """
    types = list(types) if types is not None else list(semantic_types())
    named = [c for c in df.columns if c not in skip]
    texts = [c for c in named if isinstance(df.schema[c].dataType, StringType)]
    facts = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(t).alias("semantic_type"),
            all_valid(F.col(c), semantic_type(t).is_valid(F.col(c))).alias("fits"),
        )
        for c in named
        if c not in texts
        for t in types
    ]
    if not texts or not types:
        return df.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))
    # counts, as the optimizer drops the distinct values before an aggregate that repeats do not change
    tests = [(F.count_if(~semantic_type(t).is_valid(F.col("value"))) == 0).alias(f"t{i}") for i, t in enumerate(types)]
    seen = frequencies(df, texts).groupBy("column").agg(*tests)
    told = [F.struct(F.lit(t).alias("semantic_type"), F.coalesce(f"t{i}", F.lit(True)).alias("fits")) for i, t in enumerate(types)]
    names = df.sparkSession.createDataFrame([(c,) for c in texts], "column string")
    found = names.join(seen, "column", "left").select("column", F.inline(F.array(*told)))
    return found if not facts else found.unionByName(df.agg(F.array(*facts).alias("facts")).select(F.inline("facts")))


def columns_within(df: DataFrame, allowed: Sequence[str], skip: Sequence[str] = ()) -> DataFrame:
    """(column, fits): are all non-null values of a column in the allowed set?"""
    facts = [
        F.struct(F.lit(c).alias("column"), all_valid(F.col(c), F.col(c).isin(*allowed)).alias("fits"))
        for c in df.columns
        if c not in skip
    ]
    return df.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


def blank_columns(df: DataFrame, nulls: dict[str, int] | None = None) -> list[str]:
    nulls = nulls or null_counts(df)
    return [c for c in df.columns if nulls[c] == nulls[""]]


def sparse_columns(df: DataFrame, share: float = 0.5, nulls: dict[str, int] | None = None) -> list[str]:
    """Columns with more than ``share`` of their cells missing."""
    nulls = nulls or null_counts(df)
    return [c for c in df.columns if nulls[c] > share * nulls[""]]


def droppable_columns(df: DataFrame, percent: int = 75, nulls: dict[str, int] | None = None) -> list[str]:
    """Columns whose rounded missing percentage reaches ``percent``."""
    nulls = nulls or null_counts(df)
    return [c for c in df.columns if nulls[""] and round(100 * nulls[c] / nulls[""]) >= percent]


def drop_blank_columns(df: DataFrame) -> DataFrame:
    return df.drop(*blank_columns(df))


def drop_sparse_columns(df: DataFrame, share: float = 0.5) -> DataFrame:
    return df.drop(*sparse_columns(df, share))


def drop_mostly_missing(df: DataFrame, percent: int = 75) -> DataFrame:
    return df.drop(*droppable_columns(df, percent))
