"""Every query of the engine against its SQL twin."""

import pytest
from compare import rows, tables

import __spark_entry__ as entry
from strandly.plans.oracle import SQL
from strandly.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(small):
    return tables(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    got = QUERIES[name](spark, small).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
