import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanlens.llm import simhash
from spanlens.llm.simhash import TrieJoin, keep_one, near_duplicates


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    prints = [slow_fingerprint(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)]
    rows = [(None, "No id here"), (900, None), (901, ""), (902, " \n\t"), (903, "One two"), (904, "oNe  Two"), (905, "One two"), (905, "One two")]
    for g in range(12):
        words = rng.choices(vocab, k=rng.choice([5, 40, 400, 3000]))
        for _ in range(rng.randint(1, 6)):
            other = list(words)
            for _ in range(rng.randint(0, 2)):
                other[rng.randrange(len(other))] = "changed"
            rows.append((len(rows), " ".join(other).title() if rng.random() < 0.3 else "  ".join(other)))
    return rows


@pytest.mark.parametrize("seed, subtree, part", [(1, 4096, 1 << 16), (2, 2, 1 << 16), (3, 8, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, subtree, part):
    monkeypatch.setattr(simhash, "SUBTREE", subtree)
    monkeypatch.setattr(simhash, "PART", part)
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, fingerprint string, component_id string")
    got = sorted((tuple(r) for r in near_duplicates(docs).collect()), key=str)
    assert got == slow_components(rows)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).collect() == []


def test_very_long_text():
    words = [f"w{i % 911}x{i % 7}" for i in range(130_000)]
    assert simhash.fingerprint(" ".join(words)) == slow_fingerprint(" ".join(words))


def test_trie_join_links_what_all_pairs_link():
    rng = np.random.default_rng(3)
    values = []
    for base in rng.integers(0, 2**63, 40):
        for _ in range(12):
            v = int(base)
            for _ in range(rng.integers(0, 6)):
                v ^= 1 << int(rng.integers(0, 64))
            values.append(v)
    x = np.unique(np.array(values, np.uint64))

    def groups(pairs):
        root = {int(v): int(v) for v in x}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in pairs:
            a, b = find(int(a)), find(int(b))
            root[max(a, b)] = min(a, b)
        return {v: find(v) for v in root}

    i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4, 1))
    want = groups(zip(x[i], x[j]))
    assert groups(zip(*TrieJoin(x, None, 4).run())) == want
    cut = rng.random(len(x)) < 0.5
    found = []
    for left, right in ((x[cut], None), (x[~cut], None), (x[cut], x[~cut])):
        found += zip(*TrieJoin(left, right, 4).run())
    assert all((int(a) ^ int(b)).bit_count() <= 4 for a, b in found)
    assert groups(found) == want


def test_keep_one_leaves_one_row_of_each_group(spark):
    rows = corpus(5)
    docs = spark.createDataFrame([(d, t, "n") for d, t in rows], "doc_id long, text string, n string")
    kept = sorted((r.doc_id for r in keep_one(docs).collect()), key=str)
    assert kept == sorted({c for _, _, c in slow_components(rows)}, key=str)
    assert keep_one(docs).columns == docs.columns
