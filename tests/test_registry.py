"""Every registered query against its SQL, run by DuckDB over the same files."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from bibliospark.plans.base import ORACLE, QUERIES
from tests.oracle import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    assert differences(df, con, ORACLE[name]) == []


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "title", "citation_count", "author_names"]
    assert df.count() > 0


def test_entry_stands_without_the_llm_part():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("bibliospark.llm"):
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
from bibliospark.plans.base import QUERIES
assert set(e.queries()) == set(QUERIES), "queries differ"
# an approximate search has recall, not SQL
assert set(QUERIES) - set(e.oracle_sql()) == {"similar_vectors_in_cells"}, "SQL is missing"
"""
    root = Path(__file__).parent.parent
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
