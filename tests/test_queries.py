"""Every registered query against its SQL twin, exact values and types."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

from .conftest import TESTDATA
from .oracle_check import compare, duck

FOLDER = os.environ.get("ORACLE_SF_DIR", f"{TESTDATA}/sf0.01")  # the smallest with routine cases
ROWS_ONLY = {"reallocation_plan", "boosted_tree_metrics", "boosted_tree_importances", "leafwise_metrics"}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_only_solver_and_tree_queries_lack_a_twin():
    assert set(entry.QUERIES) - set(entry.oracle_sql()) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.QUERIES) - ROWS_ONLY))
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("gone, imports", [("xxhash", True), ("regex", True), ("public_tokenizers", True), ("corpus_pipeline", True), ("cellgrid.llm", True),
                                           ("cellgrid.operators.leafwise", False)])
def test_entry_without_a_module(gone, imports):
    code = f"import sys; sys.modules[{gone!r}] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') for n in q))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(entry.__file__))
    if imports:
        assert done.stdout.split() == [str(len(entry.QUERIES)), "0"], done.stderr
    else:
        assert done.returncode and gone in done.stderr


def test_entry(spark):
    assert entry.entry(spark).count() == 61
