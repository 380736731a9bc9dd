import random

from pyspark.sql import functions as F

from spanlens.llm import rowmarks
from spanlens.llm.mixing import apply_mix, mix
from spanlens.llm.rowmarks import FILE, ROW, Placed, is_plain_scan
from spanlens.llm.simhash import keep_one
from spanlens.llm.storage import materialize
from spanlens.llm.textbytes import hold_batches


def test_rows_are_dropped_and_repeated_where_they_lie(spark):
    rng = random.Random(1)
    rows = [(i % 50 if i % 9 else None, f"t{rng.random()}" if i % 7 else None, "x") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copies string").repartition(5)
    for some in (docs, materialize(docs, "rows")):  # without and with files
        table = Placed(some)
        seen = table.select(doc_id=F.col("doc_id"), text=F.col("text"), copies=F.col("copies"))
        n = F.pmod(F.xxhash64("text", FILE, ROW), F.lit(4)).cast("int")
        marks = seen.select(FILE, ROW, n.alias("copies"))
        want = sorted((tuple(r)[:3] for r in seen.withColumn("n", n).collect() for _ in range(r.n)), key=str)
        out = table.take(marks)
        assert out.columns == docs.columns
        assert sorted((tuple(r) for r in out.collect()), key=str) == want


def test_nothing_decided_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    table = Placed(docs)
    assert table.take(table.select(doc_id=F.col("doc_id")).select(FILE, ROW, F.lit(0).alias("copies"))).collect() == []
    empty = Placed(docs.limit(0))
    assert empty.take(empty.select(doc_id=F.col("doc_id")).select(FILE, ROW, F.lit(1).alias("copies"))).collect() == []


def test_chunks(spark):
    docs = materialize(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).coalesce(1), "rows")
    table = Placed(docs)
    assert rowmarks.CHUNK > 3000
    some = table.select(doc_id=F.col("doc_id")).where("doc_id % 3 = 0").select(FILE, ROW, F.lit(2).alias("copies"))
    assert sorted(r.doc_id for r in table.take(some).collect()) == sorted([i for i in range(0, 3000, 3)] * 2)


def test_more_copies_than_a_byte_holds(spark):
    docs = materialize(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), "rows")
    table = Placed(docs)
    marks = table.select(doc_id=F.col("doc_id")).select(FILE, ROW, F.when(F.col("doc_id") == 1, 300).otherwise(70_000).alias("copies"))
    assert {r.doc_id: r["count"] for r in table.take(marks).groupBy("doc_id").count().collect()} == {1: 300, 2: 70_000}
    rows = materialize(spark.createDataFrame([(1, "a", "x y z"), (2, "a", "p q")], "doc_id long, source string, text string"), "rows")
    want = {r.doc_id: r.copies for r in mix(rows, share=300.0, most=400.0).collect()}
    got = {r.doc_id: r["count"] for r in apply_mix(rows, share=300.0, most=400.0).groupBy("doc_id").count().collect()}
    assert got == want and max(want.values()) > 255


def frames(spark):
    """The same sixteen rows, two of each of eight texts, made in ways that keep or lose row places."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(8)]
    stored = materialize(spark.createDataFrame(rows, "doc_id long, text string"), "rows")
    twice = F.explode(F.array(F.lit(1), F.lit(2))).alias("n")
    other = materialize(spark.createDataFrame([(1,), (2,)], "n long"), "rows")
    yield "exploded", stored.select("doc_id", "text", twice).drop("n"), False
    yield "joined", stored.crossJoin(other).drop("n"), False
    yield "union", stored.union(stored), False
    yield "stored", materialize(stored.union(stored), "rows"), True
    yield "selected", materialize(stored.union(stored), "rows").where("doc_id >= 0").select("doc_id", "text"), True
    yield "at random", materialize(stored.union(stored), "rows").where(F.rand(1) >= 0), False


def test_frames_whose_rows_share_a_place(spark):
    for name, docs, plain in frames(spark):
        assert is_plain_scan(docs) == plain, name
        assert docs.count() == 16
        assert sorted(r.doc_id for r in keep_one(docs).collect()) == list(range(8)), name


def test_columns_of_any_name(spark):
    names = "__file __row __file_ _metadata copies root fp shingle_id keys mix block size target hot_doc_id piece".split()
    rows = [(i, f"one two three four five six {i // 2}", "s", *[f"{c}{i}" for c in names]) for i in range(10)]
    for stored in (True, False):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names))
        docs = materialize(docs, "rows") if stored else docs
        kept = keep_one(docs, similar=(5, 0.8))
        assert kept.columns == docs.columns
        assert all(tuple(r) in rows for r in kept.collect())
        assert mix(docs).count() == 10
        mixed = apply_mix(docs)
        assert mixed.columns == docs.columns and all(tuple(r) in rows for r in mixed.collect())


def test_batch_limits_with_units(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for said, left in (("64m", str(4 << 20)), ("64MB", str(4 << 20)), ("1m", "1m"), ("4096", "4096")):
            spark.conf.set(key, said)
            hold_batches(spark)
            assert spark.conf.get(key) == left
    finally:
        spark.conf.set(key, before)
