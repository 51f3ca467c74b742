"""Every registered query against its SQL; those without SQL must run."""

import pytest

from ledgerloom.plans import registry

from .oracle import assert_same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(registry.QUERIES[name], registry.ORACLE_SQL[name], spark, sf_dir)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() >= 0


def test_flagship_is_registered():
    assert registry.FLAGSHIP in registry.QUERIES
