import random
import re

import numpy as np
import pytest

from spanlens.llm import decontam
from spanlens.llm.decontam import FMIndex, contamination, keep_clean, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, window=13):
    out = []
    grams = []
    for i, text in items:
        line = words(text)
        for k in range(max(1, len(line) - window + 1) if line else 0):
            grams.append((str(i) if i is not None else "", line[k : k + window]))
    for d, text in docs:
        line = words(text)
        hit, found = set(), set()
        for i, gram in grams:
            for k in range(len(line) - len(gram) + 1):
                if line[k : k + len(gram)] == gram:
                    hit.update(range(k, k + len(gram)))
                    found.add(i)
        out.append((d, len(line), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(line)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abÀß9", k=rng.randint(1, 3))) for _ in range(40)]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 4, 13, 14, 30]))) for i in range(1000, 1012)] + [(7, ""), (8, None), (None, text(20)), (1000, text(15))]
    docs = [(0, None), (1, ""), (None, items[0][1]), (2, "?!"), (3, items[4][1]), (3, items[4][1])]
    for i in range(30):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(items)[1] or ""
            parts += [item.upper() if rng.random() < 0.3 else item, text(rng.randint(0, 200))]
        docs.append((10 + i, " ".join(parts)))
    return docs, items


@pytest.mark.parametrize("seed, shard, block", [(1, 4_000_000, 200_000), (2, 100, 200_000), (3, 4_000_000, 20)])
def test_equals_brute_force(spark, monkeypatch, seed, shard, block):
    docs, items = corpus(seed)
    whole = decontam.phrase_blocks
    monkeypatch.setattr(decontam, "phrase_blocks", lambda *a, **k: whole(*a, **k, block_bytes=block))
    frame = spark.createDataFrame([(*r, "x", "y") for r in docs], "doc_id long, text string, items string, n_hit string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    if shard < 1000:
        blocks = decontam.phrase_blocks(bench)
        rows = list(decontam.Scanner(blocks, shard).scan([(t or "").encode() for _, t in docs]))
        got = [(d, n, decontam.hit_words(s), i, decontam.is_contaminated(n, decontam.hit_words(s))) for (d, _), (n, s, i) in zip(docs, rows)]
    else:
        got = [(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in contamination(frame, bench).collect()]
        kept = keep_clean(frame, bench)
        assert kept.columns == frame.columns
        assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _, _, _, bad in slow(docs, items) if not bad), key=str)
    assert sorted(got, key=str) == slow(docs, items)


def test_one_index_serves_all_blocks(spark, monkeypatch):
    docs, items = corpus(4)
    blocks = decontam.phrase_blocks(spark.createDataFrame([(7, t) for _, t in items], "item_id long, text string"), block_bytes=1)
    assert len(blocks.paths) > 5  # rows of one item id, in many blocks
    made = []
    init = FMIndex.__init__
    monkeypatch.setattr(FMIndex, "__init__", lambda self, *a: made.append(1) or init(self, *a))
    found = list(decontam.Scanner(blocks).scan([(t or "").encode() for _, t in docs]))
    assert len(made) == 1
    got = [(d, n, decontam.hit_words(s), i, decontam.is_contaminated(n, decontam.hit_words(s))) for (d, _), (n, s, i) in zip(docs, found)]
    assert sorted(got, key=str) == slow(docs, [(7, t) for _, t in items])


def test_very_long_text(spark):
    words = [f"w{i % 997}x{i % 13}" for i in range(300_000)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    bench = spark.createDataFrame([(5, " ".join(words[100:140])), (6, "not there at all")], "item_id long, text string")
    row = contamination(docs, bench).first()
    line, window = np.array(words), words[100:140]
    hit = np.zeros(len(line), bool)
    for k in range(28):
        ok = np.ones(len(line) - 12, bool)
        for j in range(13):
            ok &= line[j : len(line) - 12 + j] == window[k + j]
        for at in np.flatnonzero(ok):
            hit[at : at + 13] = True
    assert (row.n_words, row.n_hit, row["items"]) == (300_000, int(hit.sum()), ["5"])


def test_spans_are_merged(spark):
    docs = spark.createDataFrame([(1, "x a b c a b c y a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "A b, c")], "item_id long, text string")
    row = contamination(docs, bench).first()
    assert [tuple(s) for s in row.spans] == [(1, 7), (8, 11)]


def test_no_items_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in contamination(docs, none).collect()] == [(3, 0, False)]
    assert contamination(docs.limit(0), none).collect() == []


def test_index_counts_and_locates():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 4, 3000)
    symbols[0] = 0
    index = FMIndex(symbols, 4)
    assert sorted(suffix_array(symbols).tolist()) == list(range(3000))
    for n in (1, 2, 5):
        phrase = rng.integers(1, 4, (20, n))
        lo, hi = index.search(phrase)
        for k in range(20):
            want = [i for i in range(3001 - n) if (symbols[i : i + n] == phrase[k]).all()]
            assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want
