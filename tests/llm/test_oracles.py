"""The corpus queries that SQL can express, against their DuckDB texts on the shared tables."""

from __future__ import annotations

import pytest

from spanwise.llm import registry
from tests.oracle import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_duckdb(spark, name):
    assert spark_rows(registry.queries()[name](spark, SF)) == duck_rows(connect(SF), registry.oracle_sql()[name])


def test_one_query_for_each_operator():
    numbers = [name.split("_")[0] for name in registry.queries() if name != "pipeline"]
    assert sorted(numbers) == sorted(f"op{n}" for n in range(1, 14))
