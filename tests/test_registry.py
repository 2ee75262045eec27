"""Every registered query against its SQL on the smallest data set."""

import pytest

from tessella import checks
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = checks.load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, note = compare(QUERIES[name], ORACLE[name], spark, con, SF)
    assert ok and "types differ" not in note, note


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
