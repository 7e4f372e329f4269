"""Registered queries against their SQL on the smallest data set (one query stands for the 58 single checks)."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalog.compare import compare, duck
from catalog.registry import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = [n for n in QUERIES if not n.startswith("check_") or n in ("check_results", "check_S17", "check_G3")]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    state, rows, note = compare(spark, con, name, queries()[name], oracle_sql().get(name), SF)
    assert state in ("ok", "rows-only"), note
    assert rows > 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
