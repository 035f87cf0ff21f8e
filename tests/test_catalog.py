"""Every registered query beside its SQL in DuckDB, on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, duck, name):
    verdict, _ = compare(spark, duck, FOLDER, name)
    assert verdict.startswith(("ok", "rows only")), verdict


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() == 12 and df.columns == ["month", "id", "name", "item_count"]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
