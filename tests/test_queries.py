"""Every registered query against its SQL on the smallest data."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tools.compare import compare, open_duck
from workload.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return open_duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    verdict, rows, _ = compare(spark, FOLDER, name, duck)
    assert verdict in ("ok", "rows only") and rows > 0


def test_every_sql_has_a_query_and_entry_runs(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["day", "time", "active_trips"]
