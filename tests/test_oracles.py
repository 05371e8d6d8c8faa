"""Every registered query with SQL against DuckDB, the others for a non-empty result."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

HEAVY = {"batch_run", "analyze_k", "full_run_summary", "k_sweep", "train_profile"}  # see test_runs.py


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - HEAVY))
def test_has_rows(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["cluster"] for r in rows] == list(range(len(rows))) and rows
