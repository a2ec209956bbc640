"""Every query with SQL gives the same rows as its SQL."""

import pytest

from quillstack.plans.queries import QUERIES, SQL
from tests.compare import compare, connect
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], SQL[name]) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
