"""Every registered query against its SQL check on the smallest data set."""

import pytest

import __spark_entry__ as entry_point
from rondo.plans.compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"
MAY_BE_EMPTY: set[str] = set()  # queries whose right answer has no rows on the smallest data set
QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    if name in ORACLES:
        message = compare(got, con.execute(ORACLES[name]).df())
        assert message is None or (message == "no rows" and name in MAY_BE_EMPTY), message
    else:
        assert len(got) > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() == 5
