import pytest

from spanlens.plans.registry import ORACLE_SQL, QUERIES
from tests.helpers import SF, same_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    same_rows(QUERIES[name](spark, SF), ORACLE_SQL[name])


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
