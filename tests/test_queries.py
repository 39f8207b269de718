"""Every registered query beside its SQL on the smallest tables; those without SQL must run and have a stable schema."""

import pytest
from oracle import compare
from loomstone.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    query = registry.queries()[name]
    if name in SQL:
        assert compare(spark, name, query, SQL[name], SF) == ""
    else:
        assert query(spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
