"""Every named query against its SQL in DuckDB on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import SMALL
from tools.compare import connect, difference, rows


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, connection, name):
    frame = queries()[name](spark, SMALL)
    cursor = connection.execute(oracle_sql()[name])
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    assert difference(got, want) is None
