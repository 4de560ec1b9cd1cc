"""Every query with SQL agrees with DuckDB."""

import pytest
from compare import differences

from loomtide.plans.oracles import ORACLES
from loomtide.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert differences(QUERIES[name](spark, SF), ORACLES[name], SF) == []


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(ORACLES) <= set(e.oracle_sql()) <= set(e.queries())
