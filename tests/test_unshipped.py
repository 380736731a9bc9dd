"""Customers whose orders never shipped: postings and contexts, but no document."""

import os
import shutil

import duckdb
import pytest

from spanlens.plans.registry import ORACLE_SQL, QUERIES
from tests.helpers import SF, same_rows

NEVER = (5, 6, 7, 12, 15, 20, 31, 44, 60)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("unshipped"))
    for name in ("customer", "orders"):
        shutil.copy(f"{SF}/{name}.parquet", folder)
    kept = f"l_orderkey NOT IN (SELECT o_orderkey FROM '{SF}/orders.parquet' WHERE o_custkey IN {NEVER})"
    duckdb.sql(f"COPY (SELECT * FROM '{SF}/lineitem.parquet' WHERE {kept}) TO '{os.path.join(folder, 'lineitem.parquet')}' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", ["requirement_gap", "requirement_notes", "buzzword_line_counts", "repeated_lines", "render_jobs", "dossier"])
def test_query_equals_its_sql(spark, tables, name):
    assert same_rows(QUERIES[name](spark, tables), ORACLE_SQL[name], tables) > 0
