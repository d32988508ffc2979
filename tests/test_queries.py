"""Every registered query against its SQL twin, and the driver contract."""

import pytest
from compare import connect, difference, duck_rows, spark_rows

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, con, name):
    got = spark_rows(QUERIES[name](spark, folder))
    if name in ORACLES:
        assert difference(got, duck_rows(con, ORACLES[name])) is None
    else:
        assert len(got[1]) > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
