"""Registered queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import check
from workload.queries import REGISTRY

SMALL = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(REGISTRY) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, name):
    ok, _, _, note = check(spark, SMALL, name)
    assert ok, note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["partition", "offset", "line"] and df.count() > 0
