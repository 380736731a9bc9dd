import pytest

from spanlens.llm.queries import ORACLE_SQL, QUERIES
from tests.helpers import SF, same_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert same_rows(QUERIES[name](spark, SF), ORACLE_SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_returns_a_row_for_each_row(spark, name):
    table = "embeddings" if name.startswith("op9") else "documents"
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
