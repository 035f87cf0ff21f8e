"""Compute an expression once where plain nesting would repeat it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value)."""
    return F.transform(F.array(value), f)[0]


def only_if(value: Column, test: Callable[[Column], Column]) -> Column:
    """The value if it passes the test, else null."""
    return F.get(F.filter(F.array(value), test), F.lit(0))
