"""The registered queries against DuckDB on the smallest tables, and the driver's contract without the training-data operators."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

from corvane.plans import registry
from tests.oracle import compare

ROOT, DATA = Path(__file__).resolve().parent.parent, "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="the test tables are not here")
SQL = registry.oracle_sql()


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark: SparkSession, name: str) -> None:
    compare(registry.queries()[name](spark, DATA), SQL[name], DATA)


def test_every_query_but_those_that_sql_cannot_say_has_sql() -> None:
    assert set(registry.queries()) - set(SQL) == {"chunk_split", "chunk_emission", "chunk_subwords", "vector_index_topk"}


def test_nothing_else_imports_the_training_operators() -> None:
    for path in (ROOT / "corvane").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"corvane\.llm|from corvane import llm", path.read_text()), path


def test_the_entry_works_without_them() -> None:
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[0] == 'corpus_pipeline' or name.startswith('corvane.llm'):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert 'rrf_fused_topk' in e.queries() and 'pipeline' not in e.queries() and not any(q.startswith('op1_') for q in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)
