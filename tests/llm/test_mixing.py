import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spanlens.llm import mixing
from spanlens.llm.mixing import apply_mix, flight, mix
from spanlens.llm.rowmarks import Placed
from spanlens.llm.storage import materialize


def slow_targets(rows):
    size = defaultdict(int)
    for _, source, text in rows:
        size[source] += len((text or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(size.values()), set(order), {s: 0.0 for s in order}
    while free and left > 0:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * size[s]}
        if not over:
            target.update({s: left * weight[s] / total for s in free})
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= over
    return size, target


def rows_of(seed, n=3000):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["b", "a", "a", "a", "é", "Z", None]), "w " * rng.choice([0, 1, 5, rng.randint(0, 400)])) for i in range(n)]
    return rows + [(None, "a", "x y"), (5, "a", None), (6, "only empty", ""), (7, "b", "q r s"), (7, "b", "q r s")]


@pytest.mark.parametrize("seed, block", [(1, 4096), (2, 64), (3, 5)])
def test_targets_and_totals(spark, seed, block):
    rows = rows_of(seed, 600 if block == 5 else 3000)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, taken string")
    got = mix(docs, block=block).collect()
    assert sorted(((r.doc_id, r.source, r["size"]) for r in got), key=str) == sorted(((d, s, len((t or "").split())) for d, s, t in rows), key=str)
    size, target = slow_targets(rows)
    taken = defaultdict(int)
    largest = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s]
    assert sorted(map(str, mix(docs.repartition(7), block=block).collect())) == sorted(map(str, got))


def test_repeated_rows_beyond_a_block_are_cut(spark):
    rows = [(7, "a", "x y z")] * 3000 + [(None, "b", "p")] * 900 + [(i, "a", "w " * (i % 9)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    measured = docs.select("doc_id", "source", F.size(F.split("text", " ")).cast("long").alias("size"))
    placed = Placed(materialize(measured.repartition(3), "sizes")).select(**{c: F.col(c) for c in ("doc_id", "source", "size")})
    counts = mixing._numbered(placed, 64).groupBy("doc_id", "size", "piece").count().collect()
    assert max(r["count"] for r in counts) <= 64 and sum(r["count"] for r in counts) == len(rows)
    assert sorted(r.piece for r in counts if r.doc_id == 7 and r["count"] > 1) == list(range(47))
    got = [sorted(map(str, mix(d, block=64).collect())) for d in (docs, docs.repartition(5))]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    size, target = slow_targets(rows)
    for s in size:
        taken = sum(r.taken for r in mix(docs, block=64).collect() if r.source == s)
        assert abs(taken - target[s]) <= 9


def test_flight_keeps_both_sums():
    rng = random.Random(3)
    size = [rng.choice([3, 3, 50, rng.randint(0, 900)]) for _ in range(500)]
    x, held = flight(size, [0.37] * 500, rng)
    assert len(held) <= 2 and all(v in (0.0, 1.0) for k, v in enumerate(x) if k not in held)
    assert sum(x) == pytest.approx(0.37 * 500) and sum(v * s for v, s in zip(x, size)) == pytest.approx(0.37 * sum(size))


def test_flight_is_fair():
    hits = [0] * 6
    for k in range(4000):
        x, held = flight([1, 2, 3, 4, 5, 6], [0.5] * 6, random.Random(k))
        for i, v in enumerate(x):
            hits[i] += v
    assert all(abs(h / 4000 - 0.5) < 0.05 for h in hits)


def test_apply_takes_the_copies(spark):
    rows = rows_of(4, 300)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, taken string")
    out = apply_mix(docs)
    assert out.columns == docs.columns
    want = defaultdict(int)
    for r in mix(docs).collect():
        want[(r.doc_id, r.source, r["size"])] += r.copies
    got = defaultdict(int)
    for r in out.collect():
        got[(r.doc_id, r.source, len((r.text or "").split()))] += 1
    assert got == {k: v for k, v in want.items() if v}


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mix(docs).collect() == [] and apply_mix(docs).collect() == []
