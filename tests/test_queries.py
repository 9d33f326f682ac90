"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, difference

from __spark_entry__ import entry, oracle_sql, queries
from labelweave.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
ORACLES = oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    rows = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert difference(rows, connect(SF).execute(ORACLES[name]).df()) is None
    else:
        assert len(rows) > 0
        assert not rows.isna().any().any()


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(queries())
