"""Every registered query gives the rows of its SQL twin."""

import pytest
from oracle import connect, differences

import __spark_entry__ as E

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(E.QUERIES) == set(E.ORACLES)
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query(spark, con, name):
    assert differences(spark, con, SF_DIR, E.queries()[name], E.oracle_sql()[name]) is None


def test_entry(spark):
    rows = E.entry(spark).collect()
    assert [r["distance"] for r in rows] == sorted(r["distance"] for r in rows)
    assert len(rows) == 3 and rows[0]["vec_id"] == 0 and rows[0]["distance"] == 0.0
