"""The registered queries on the smallest tables, against DuckDB where there is SQL."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import SparkSession

from corvane.llm import queries
from tests.oracle import compare

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark: SparkSession, name: str) -> None:
    compare(queries.queries()[name](spark, DATA), queries.oracle_sql()[name], DATA)


def test_all_are_registered() -> None:
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]
