"""Every query of the engine against its SQL; those without SQL have tests of their own in this folder."""

import pytest
from compare import connect, same

from viewloom.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="session")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, con, name):
    same(registry.queries()[name](spark, data), con, SQL[name])


def test_entry_has_rows(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["pair", "mi"] and out.count() == 28
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
