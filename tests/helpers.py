"""Frames from Python rows, and SQL over the test tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one(spark, column_of, *texts):
    """A column function applied to each text."""
    from pyspark.sql import functions as F

    rows = docs(spark, *texts).select("doc_id", column_of(F.col("text")).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.doc_id)]


def sql(query, sf_dir=SF):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = con.sql(query)
    return list(found.columns), found.fetchall()


def same_rows(frame, query, sf_dir=SF):
    """Whether a query's rows equal those of its SQL, columns by name."""
    columns, rows = sql(query, sf_dir)
    assert sorted(frame.columns) == sorted(columns)
    got = [[r[c] for c in sorted(columns)] for r in frame.collect()]
    want = [[r[columns.index(c)] for c in sorted(columns)] for r in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return len(got)
