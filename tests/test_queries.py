"""Registered queries against independent SQL, and the driver contract."""

import compare
import pytest

import __spark_entry__ as entry

from gaugeflow.oracles import ORACLES
from gaugeflow.queries import QUERIES


@pytest.fixture(scope="module")
def db(sf):
    return compare.connect(sf)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["series", "t", "m", "s", "n", "min", "max"]


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, sf, db, name):
    rows = db.execute(f"SELECT count(*) FROM ({ORACLES[name]})").fetchone()[0]
    assert rows > 0
    assert compare.differences(QUERIES[name](spark, sf), db, ORACLES[name]) == ""
