import random

from corpus_pipeline import near_dedup_stage
from spanlens.llm.simhash import fingerprint


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def corpus():
    """Texts in pairs at similarities around 0.8, most of them more than 4 bits apart, and one chain."""
    rng, rows = random.Random(3), []
    vocab = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(2000)]
    for g in range(40):
        words = rng.choices(vocab, k=rng.choice([60, 120, 300]))
        other = list(words)
        for _ in range(rng.randint(1, max(1, len(words) // 40))):
            other[rng.randrange(len(other))] = "changed"
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    words = rng.choices(vocab, k=400)
    for step in range(4):
        rows.append((len(rows), " ".join(words[: 400 - 40 * step])))
    return rows + [(900, None), (901, ""), (902, "One two"), (903, "oNe  two")]


def expected(rows):
    sets, prints, root = [shingles(t) for _, t in rows], [fingerprint(t) for _, t in rows], list(range(len(rows)))
    far = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            alike = bool(sets[i]) and both >= 0.8 * len(sets[i] | sets[j])
            near = (prints[i] ^ prints[j]).bit_count() <= 4
            far += alike and not near
            if alike or near:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [rows[i] for i in range(len(rows)) if root[i] == i], far


def test_near_dedup_joins_all_similar_texts(spark):
    rows = corpus()
    want, far = expected(rows)
    assert far > 10
    got = near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(map(tuple, got.collect())) == want


def test_large_groups_are_cut_into_parts(spark, monkeypatch):
    from spanlens.llm import shingles as module

    monkeypatch.setattr(module, "SET_PART", 2)
    monkeypatch.setattr(module, "SKETCH_PART", 2)
    rows = corpus()
    got = near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(map(tuple, got.collect())) == expected(rows)[0]
