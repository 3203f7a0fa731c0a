"""Every registered query with a SQL oracle equals DuckDB on the small tables."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import compare, duck

from conftest import SMALL

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLE[name], SMALL)
    assert r["status"] == "match", r


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_query_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.count() >= 0
    assert len(df.columns) > 0


def test_every_query_has_a_docstring():
    for name, fn in QUERIES.items():
        assert fn.__doc__, name


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "n_docs", "tokens_used", "context"]
    assert df.count() >= 0


def test_contract_consistency():
    assert set(ORACLE) <= set(QUERIES)
    assert all(callable(f) for f in QUERIES.values())
    assert all(isinstance(s, str) and s.strip() for s in ORACLE.values())
