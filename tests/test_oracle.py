import os, sys; sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
"""Every registered query with oracle SQL equals DuckDB on the sf0.001 tables."""

import pytest

from jobsight.plans.registry import all_queries
from oracle_check import compare, duck

SMALL = "/root/testdata/sf0.001"
NAMES = sorted(n for n, q in all_queries().items() if q.sql)


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, all_queries()[name], SMALL)
    assert ok, msg


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
