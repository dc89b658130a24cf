"""Every registered query with oracle SQL equals DuckDB on sf0.001 (the driver checks sf0.01)."""

import pytest

from scriptorium.plans.catalog import QUERIES
from scriptorium.plans.verify import check

from conftest import SF001

SQL_QUERIES = sorted(n for n, (_fn, sql) in QUERIES.items() if sql is not None)


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_query_matches_oracle(spark, name):
    res = check(spark, [name], SF001, verbose=False)
    assert res[name] is True


def test_rows_only_queries_run(spark):
    for name in sorted(n for n, (_fn, sql) in QUERIES.items() if sql is None):
        assert check(spark, [name], SF001, verbose=False)[name][1] >= 0


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
