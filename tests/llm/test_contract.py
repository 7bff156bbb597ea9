"""Every query of the subpackage against its SQL twin, where it has one."""

import pytest
from compare import connect, differences
from conftest import SF_DIR

import __spark_entry__ as contract
from drayline.llm import queries

SQL = contract.oracle_sql()


def test_all_are_registered():
    names = contract.queries()
    for n in range(1, 14):
        assert any(name.startswith(f"op{n}_") for name in names)
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    assert differences(contract.queries()[name](spark, SF_DIR), connect(SF_DIR), SQL[name]) is None
