"""Every registered query equals its DuckDB statement on the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from check_oracle import compare, duck
from oracles import statements
from tallyhouse import registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_equals_oracle(spark, connection, name):
    ok, note = compare(spark, connection, name, SF_DIR)
    assert ok, note


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(statements())


def test_entry_runs(spark):
    assert contract.entry(spark).columns == ["gmv", "order_count", "aov"]
