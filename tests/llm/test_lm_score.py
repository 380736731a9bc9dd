import math
import random
from collections import Counter

import pytest

from spanlens.llm import lm_score
from spanlens.llm.lm_score import score_against_labelled
from spanlens.llm.textbytes import alnum_words


def slow_scores(docs, good):
    """Scores with all counts in one place; a document's own are taken out for it."""
    def grams(text):
        words = alnum_words((text or "").encode())
        return Counter([(w,) for w in words] + list(zip([None, *words], words))), len(words)

    held = [(d, *grams(t), d in good) for d, t in docs]
    target, background = Counter(), Counter()
    for _, found, _, flag in held:
        background.update(found)
        if flag:
            target.update(found)
    n_target, n_all = sum(n for _, _, n, flag in held if flag), sum(n for _, _, n, _ in held)
    scale = n_target / max(n_all, 1)
    out = []
    for d, found, n, flag in held:
        total = sum(k * math.log((scale * (background[g] - k) + 0.5) / (target[g] - k * flag + 0.5)) for g, k in found.items())
        out.append((d, n, total / max(2 * n, 1)))
    return out


def agree(got, want):
    key = lambda r: (str(r[0]), r[1], round(r[2], 6))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-9)


@pytest.mark.parametrize("sizes", [(), (50, 7, 40, 2), (1, 1, 25, 3), (300, 1000, 60, 1000)])
def test_equals_brute_force(spark, sizes):
    rng = random.Random(7)
    vocab = ["the", "The", "of", "é", "a1", "x-y", *("".join(rng.choices("abcd", k=3)) for _ in range(40))]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 40)))) for i in range(60)]
    docs += [(None, "no id the of"), (90, None), (91, ""), (92, " .,\n"), (3, docs[3][1]), (3, docs[3][1]), (93, "the " * 3000)]
    labels = [(i, int(i % 2 == 0)) for i in range(0, 60, 3)] + [(None, 1), (5, None), (6, 1), (6, 0), (93, 1)]
    frame = spark.createDataFrame([(*d, "x", "y", "z") for d in docs], "doc_id long, text string, difference string, __file string, data string").repartition(3)
    got = score_against_labelled(frame, spark.createDataFrame(labels, "doc_id long, quality int"), sizes=lm_score.Sizes(*sizes)).collect()
    agree(got, slow_scores(docs, {d for d, q in labels if q == 1 and d is not None}))


def test_target_like_text_scores_lower(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(["stone", "river", "cloud"] if i % 2 else ["1x9", "zq", "7"], k=30))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    score = {r.doc_id: r.difference for r in score_against_labelled(frame, labels).collect()}
    assert max(v for k, v in score.items() if k % 2) < min(v for k, v in score.items() if not k % 2)


def test_no_rows_and_no_labels(spark):
    frame = spark.createDataFrame([(1, "abc"), (2, "abc d")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert sorted(map(tuple, score_against_labelled(frame, none).collect())) == [(1, 1, 0.0), (2, 2, 0.0)]
    assert score_against_labelled(frame.limit(0), none).collect() == []


def test_packed_arrays_come_back():
    import numpy as np

    arrays = [np.arange(5, dtype="<u2"), np.zeros(0, "<f8"), np.array([-3], "<i8")]
    back = lm_score.unpack(lm_score.pack(*arrays))
    assert [a.tolist() for a in arrays] == [b.tolist() for b in back] and [a.dtype for a in arrays] == [b.dtype for b in back]
