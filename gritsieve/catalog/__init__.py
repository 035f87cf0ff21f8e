"""The catalogue: every operator as a query over the given tables, with its SQL check."""

from gritsieve.catalog import cleaning, distributions, relational, reports, scalars, statistics  # noqa: F401
from gritsieve.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
