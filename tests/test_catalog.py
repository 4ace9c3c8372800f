from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from oracles.sql import ORACLES
from tests.compare import check, connect
from tillgrain.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.items() <= entry_points.queries().items()
    assert ORACLES.items() <= entry_points.oracle_sql().items()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert check(spark, FOLDER, con, QUERIES[name], ORACLES[name]) == []
