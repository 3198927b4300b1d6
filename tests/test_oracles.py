"""Every library query against its SQL on the smallest tables; those without SQL must run."""

import pytest
from lectern.plans import registry

from .oracle import both

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    mine, theirs = both(spark, SF, registry.queries()[name], registry.oracle_sql()[name])
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
