import pytest

from quaystone.queries import data_ops, data_ops_sql, star, star_sql
from tests.against_sql import check, connect

QUERIES, SQL = data_ops.QUERIES | star.QUERIES, data_ops_sql.SQL | star_sql.SQL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, sf, name):
    check(spark, con, sf, QUERIES[name], SQL[name])
