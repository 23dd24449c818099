"""Every query with a SQL twin gives the twin's rows."""

import os

import pytest
import twins

import __spark_entry__ as entry

FOLDER = os.environ.get("TWINS_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return twins.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, con, name):
    assert twins.compare(entry.queries()[name](spark, FOLDER), con, SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_every_twin_has_a_query():
    assert set(SQL) <= set(entry.queries())
