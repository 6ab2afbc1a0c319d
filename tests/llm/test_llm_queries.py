"""Registered corpus queries against their SQL, and planned shapes."""

import pytest

import check_oracles
from shelfwatch.llm import registry


@pytest.mark.parametrize("name", sorted(registry.all_oracles()))
def test_query_matches_sql(spark, sf_dir, name):
    duck = check_oracles.duck_tables(sf_dir)
    ok, message = check_oracles.compare(spark, duck, name, sf_dir)
    assert ok, message
