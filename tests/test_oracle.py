"""Every registered query against its DuckDB oracle (or a rows check) on the smallest tables."""

import pytest

from corpusforge.plans.catalog import all_queries
from corpusforge.plans.check import compare, duck
from tests.conftest import SF_SMALL

QUERIES = all_queries()
WITH_SQL = sorted(n for n, q in QUERIES.items() if q.sql is not None)
ROWS_ONLY = sorted(n for n, q in QUERIES.items() if q.sql is None)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_oracle(spark, con, name):
    q = QUERIES[name]
    r = compare(spark, name, q.build, q.sql, SF_SMALL, con)
    assert r["status"] == "ok", r


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name].build(spark, SF_SMALL)
    assert df.count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert set(df.columns) == {"sentence", "label", "hostname"}
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
