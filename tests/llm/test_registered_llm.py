import pytest

from quaystone.llm.queries import QUERIES
from quaystone.llm.sql import SQL
from tests.against_sql import check, connect


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    check(spark, connect(sf), sf, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
