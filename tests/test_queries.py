"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries, registry
from check_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


# Too few posts for a word to decline.
SPARSE = {"dying_trends", "saturation_timeline"}


@pytest.mark.parametrize("name", sorted(registry()))
def test_matches_sql(spark, connection, name):
    problem = compare(spark, connection, FOLDER, registry()[name])
    assert problem is None or (name in SPARSE and problem == "no rows"), problem


def test_entry_and_contract(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
