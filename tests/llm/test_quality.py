import random
import zlib

import numpy as np
import pytest

from spanlens.llm import quality
from spanlens.llm.quality import FEATURES, features, fit, keep_good, score, train


def corpus(n=400):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(rng.randint(5, 80))]
        good = rng.random() < 0.7
        docs.append((i, " ".join(words) + "." if good else " ".join(w + rng.choice(["###", "$$$", "!!"]) for w in words).upper()))
        if i % 3:
            labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_whole_result(spark):
    docs, labels = corpus()
    docs += [(None, "no id"), (9000, None), (9001, ""), (5, docs[5][1])]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = train(frame, marks)
    got = score(frame, model).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((d for d, _ in docs), key=str)
    truth = dict((d, q) for d, q, _ in labels)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    out = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(out) > 20 and np.mean([a == b for a, b in out]) > 0.95
    kept = keep_good(frame, model)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r.doc_id for r in got if r.predicted), key=str)


def test_held_out_labels_are_never_used(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    flipped = [(i, 1 - q if held(i) else q, t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (score(frame, train(frame, spark.createDataFrame(x, schema))).collect() for x in (labels, flipped))
    assert sorted(a) == sorted(b)


def test_tables_equal_direct_sum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = fit(x, y)
    assert model.pairs[0] == (0, 1) and np.mean((model.score(x) > 0.5) == y) > 0.9
    for row, got in zip(x[:50], model.score(x[:50])):
        total = model.intercept + sum(t[(row[j] >= e).sum()] for j, (e, t) in enumerate(zip(model.edges, model.tables)))
        total += sum(t[(row[i] >= model.coarse[i]).sum(), (row[j] >= model.coarse[j]).sum()] for (i, j), t in zip(model.pairs, model.pair_tables))
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)]])
def test_few_labels(spark, labels):
    frame = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string")
    model = train(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert len(score(frame, model).collect()) == 2
    assert score(frame.limit(0), model).collect() == []


def test_features_are_finite():
    x = features([b"", b" \n", b"a", b"\xff\xfe", b"|" * 100000, ("É\n" * 9).encode()])
    assert x.shape == (6, len(FEATURES)) and np.isfinite(x).all()
    assert quality.MOST_ROWS == 20_000
