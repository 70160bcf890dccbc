"""Every registered query against its DuckDB text, and the contract of the entry module."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tests.oracle import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
QUERIES, TEXTS = contract._span_queries(), contract._span_texts()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_a_text():
    assert set(QUERIES) == set(TEXTS)


def test_entry(spark):
    assert contract.entry(spark).count() == 143


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_duckdb(spark, duck, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(duck, TEXTS[name])
