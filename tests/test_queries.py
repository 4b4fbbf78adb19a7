"""Every registered query of the library against its SQL on DuckDB, on the smallest tables."""

import pytest
from compare import DATA, compare, connect

from augury import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    assert compare(spark, con, DATA, registry.queries()[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_without_sql(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
