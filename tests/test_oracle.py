"""Every query that has oracle SQL gives the same rows as DuckDB; the others give rows."""
import pytest

import __spark_entry__ as entry
import check

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return check.connect(sf)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(key, spark, con, sf):
    state, n, _, message = check.compare(spark, con, QUERIES[key], ORACLES.get(key), sf)
    assert state in ("ok", "rows"), message
    if state == "rows":
        assert n > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
