"""Every registered query against its oracle, on the smallest given tables."""

import pytest

import __spark_entry__ as entry
from eventlens.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, sf, oracle, name):
    assert name in ORACLES
    error, _ = compare(spark, oracle, name, QUERIES[name], ORACLES[name], sf)
    assert error is None, error


def test_entry_has_stable_schema(spark):
    first, second = entry.entry(spark), entry.entry(spark)
    assert first.schema == second.schema
    assert first.count() > 0
