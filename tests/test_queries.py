"""Every query of the core equals its SQL; those without SQL run and keep their schema."""

import pytest

import __spark_entry__
from curvecast.plans import registry
from tests import oracle


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, con, name):
    oracle.assert_same(con, registry.QUERIES[name](spark, oracle.SF), registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, oracle.SF)
    assert df.count() > 0
    assert df.schema == registry.QUERIES[name](spark, oracle.SF).schema


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
