"""Every registered query with SQL gives that SQL's rows; the others give rows."""

from __future__ import annotations

import pytest
from quire.plans import registry

from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_rows_equal_sql(spark, sf, name):
    assert_same(spark, sf, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_gives_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
