"""Every registered query of the engine against its SQL."""

from __future__ import annotations

import pytest
from oracle import differences

from spanlens.plans import registry


def test_all_have_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    assert not differences(registry.QUERIES[name](spark, sf), registry.ORACLES[name], sf)


def test_entry(spark):
    import __spark_entry__

    assert "mean" in __spark_entry__.entry(spark).columns
