"""Every registered query against its SQL, on the smallest data."""

import pytest

from gateflow.plans import registry

from .oracle import same

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    same(spark, SF, QUERIES[name], SQL[name])


def test_every_query_has_its_sql():
    assert set(SQL) == set(QUERIES)
