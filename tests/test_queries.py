"""Every registered query against its SQL twin."""

import pytest
from compare import connect, differences
from conftest import SF_DIR

import __spark_entry__ as contract
import registry

SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = contract.queries()[name](spark, SF_DIR)
    assert name in SQL
    assert differences(df, con, SQL[name]) is None


def test_entry(spark):
    assert contract.entry(spark).count() == 150
