"""Semantic column types: the registry, and schemas that assign types to columns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType, StructField, StructType

from gritsieve.functions import nested, scalars, text


@dataclass(frozen=True)
class SemanticType:
    """A named kind of value: how to read it from text and what Spark type results."""

    name: str
    extract: Callable[[Column], Column]
    spark_type: str
    numeric: bool = False

    def is_valid(self, c: Column) -> Column:
        return self.extract(c).isNotNull()


_REGISTRY: dict[str, SemanticType] = {}


def register_type(
    name: str, extract: Callable[[Column], Column], spark_type: str, numeric: bool = False
) -> SemanticType:
    """Add or replace a type; ``extract`` maps a text column to a typed one, null if invalid."""
    _REGISTRY[name] = SemanticType(name, extract, spark_type, numeric)
    return _REGISTRY[name]


def semantic_type(name: str) -> SemanticType:
    if name not in _REGISTRY:
        raise ValueError(f"unknown semantic type: {name}")
    return _REGISTRY[name]


def semantic_types() -> dict[str, SemanticType]:
    return dict(_REGISTRY)


register_type("boolean", scalars.extract_boolean, "boolean")
register_type("dict", nested.extract_dict, "map<string,string>")
register_type("integer", scalars.extract_integer, "bigint", numeric=True)
register_type("list_of_dict", nested.extract_records, "array<map<string,string>>")
register_type("string", text.extract_string, "string")
register_type("float", scalars.extract_float, "double", numeric=True)
register_type("ymd_datetime", scalars.extract_date, "date")
register_type("status_category", scalars.extract_category, "string")


class SemanticSchema:
    """Column name to semantic type."""

    def __init__(self, columns: Mapping[str, str]):
        for kind in columns.values():
            semantic_type(kind)
        self.columns = dict(columns)

    def column_type(self, column: str) -> str:
        if column not in self.columns:
            raise ValueError(f"unknown column: {column}")
        return self.columns[column]

    def column_dtype(self, column: str) -> str:
        return semantic_type(self.column_type(column)).spark_type

    def extractor(self, column: str) -> Callable[[Column], Column]:
        return semantic_type(self.column_type(column)).extract

    def is_numeric(self, column: str) -> bool:
        return semantic_type(self.column_type(column)).numeric

    def numeric_columns(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if self.is_numeric(c)]

    def text_struct(self) -> StructType:
        """The all-text read schema; each field's metadata carries its semantic type."""
        return StructType(
            [StructField(c, StringType(), True, {"semantic_type": t}) for c, t in self.columns.items()]
        )

    def dtype_spec(self, df: DataFrame) -> dict[str, str]:
        return {c: self.column_dtype(c) for c in df.columns}

    def known(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c in self.columns]


def column_names(df: DataFrame) -> list[str]:
    return list(df.columns)


def physical_numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def verify_column_names(expected: Sequence[str], actual: Sequence[str]) -> None:
    """A ValueError that names the missing, unexpected and repeated columns; their order is free."""
    wanted, found = Counter(expected), Counter(actual)
    surplus = found - wanted
    faults = {
        "missing": wanted - found,
        "unexpected": {n: c for n, c in surplus.items() if n not in wanted},
        "repeated": {n: c for n, c in surplus.items() if n in wanted},
    }
    told = [f"{len(names)} {kind} ({', '.join(sorted(names))})" for kind, names in faults.items() if names]
    if told:
        raise ValueError("column names: " + "; ".join(told))


def extract_columns(df: DataFrame, schema: SemanticSchema, columns: Sequence[str] | None = None) -> DataFrame:
    """Typed frame: every known (or named) column replaced by its extracted value."""
    chosen = set(schema.known(df) if columns is None else columns)
    return df.select(
        *[schema.extractor(c)(F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns]
    )


# The movie metadata table's columns and their types.
MOVIE_COLUMNS = SemanticSchema(
    {
        "adult": "boolean",
        "belongs_to_collection": "dict",
        "budget": "integer",
        "genres": "list_of_dict",
        "homepage": "string",
        "id": "integer",
        "imdb_id": "string",
        "original_language": "string",
        "original_title": "string",
        "overview": "string",
        "popularity": "float",
        "poster_path": "string",
        "production_companies": "list_of_dict",
        "production_countries": "list_of_dict",
        "release_date": "ymd_datetime",
        "revenue": "integer",
        "runtime": "float",
        "spoken_languages": "list_of_dict",
        "status": "status_category",
        "tagline": "string",
        "title": "string",
        "video": "boolean",
        "vote_average": "float",
        "vote_count": "integer",
    }
)
