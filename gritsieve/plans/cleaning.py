"""The cleaning run: duplicates, empty and sparse columns, validation, scaling."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from gritsieve.operators.aggregates import null_counts
from gritsieve.operators.duplicates import first_rows
from gritsieve.operators.quality import blank_columns, null_out_invalid, sparse_columns
from gritsieve.operators.scaling import autoscale
from gritsieve.schema import SemanticSchema
from gritsieve.session import ensure_checkpoint_dir


@dataclass
class Cleaned:
    """The typed and scaled table and what the run removed."""

    table: DataFrame
    duplicates: DataFrame
    rejects: DataFrame
    dropped_columns: list[str] = field(default_factory=list)


def clean(df: DataFrame, schema: SemanticSchema, order: str, max_missing: float = 0.5, scale: bool = True) -> Cleaned:
    """Clean an all-text table.

    ``order`` is a unique row number: it decides which copy of equal rows is kept and
    identifies rejected cells. The table, each row told whether it is a first copy, is read by
    the null counts, the scaler's fit, the result and the rejects, so it is checkpointed once. Validation and
    scaling are part of the result's plan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    data = [c for c in df.columns if c != order]
    firsts = first_rows(df, data, order).distinct().select(order, F.lit(True).alias("__first"))
    told = df.join(firsts, order, "left").checkpoint()
    unique, duplicates = told.where("__first").drop("__first"), told.where("__first IS NULL").drop("__first")
    nulls = null_counts(unique)
    gone = set(blank_columns(unique, nulls)) | set(sparse_columns(unique, max_missing, nulls))
    dropped = [c for c in data if c in gone]
    typed, rejects = null_out_invalid(unique.drop(*dropped), schema, order)
    numeric = [c for c in schema.known(typed) if c != order and schema.is_numeric(c)]
    table = autoscale(typed, schema, numeric) if scale and numeric else typed
    return Cleaned(table, duplicates, rejects, dropped)
