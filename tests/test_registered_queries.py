"""Every registered query against its SQL on the given tables."""

import pytest

import __spark_entry__ as entry
import check_oracles
from shelfwatch import plans


@pytest.fixture(scope="module")
def duck(sf_dir):
    return check_oracles.duck_tables(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.all_queries()))
def test_query_matches_sql(spark, duck, sf_dir, name):
    ok, message = check_oracles.compare(spark, duck, name, sf_dir)
    assert ok, message


def test_every_query_has_sql_and_every_sql_a_query():
    assert set(plans.all_oracles()) == set(plans.all_queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
