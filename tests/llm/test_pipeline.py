import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from spanlens.llm import mixing, quality
from spanlens.llm.queries import table, tokenizer_path
from tests.llm.test_decontam import slow as slow_contamination
from tests.llm.test_shingles import expected as slow_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, seen = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        before = sorted(docs.collect())
        docs = stage(spark, docs, SF)
        seen.append((before, sorted(docs.collect()), docs.columns))
    return seen


def test_quality_keeps_what_scores(spark, stages):
    before, after, columns = stages[0]
    docs = table(spark, SF, "documents")
    model = quality.train(docs, table(spark, SF, "labels"))
    good = model.score(quality.features([r.text.encode() for r in before])) >= 0.3
    assert after == [r for r, g in zip(before, good) if g] and columns == docs.columns
    truth = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in after}
    judged = [(d in kept) == bool(q) for d, q in truth.items()]
    assert np.mean(judged) > 0.9


def test_near_dedup_keeps_the_first_of_each_group(stages):
    """Groups are those of fingerprints within 4 bits and of texts whose five-word shingles are similar by 0.8."""
    before, after, _ = stages[1]
    kept, far = slow_groups([(r.doc_id, r.text) for r in before])
    assert far > 0
    assert after == [r for r in before if (r.doc_id, r.text) in kept]


def test_decontamination_equals_brute_force(spark, stages):
    before, after, _ = stages[2]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {d for d, _, _, _, c in slow_contamination([(r.doc_id, r.text) for r in before], items) if c}
    assert after == [r for r in before if r.doc_id not in bad]


def test_mix_takes_copies(spark, stages):
    before, after, _ = stages[3]
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(before)).collect()}
    assert Counter(r.doc_id for r in after) == {d: n for d, n in copies.items() if n}
    rows = {r.doc_id: r for r in before}
    assert all(rows[r.doc_id] == r for r in after)


def test_tokens_equal_direct_encoding(stages):
    before, after, _ = stages[4]
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    at, want = 0, []
    for r in before:
        ids = np.array(t.encode(r.text, add_special_tokens=False).ids + [0], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in after] == want


def test_run_is_all_stages(spark, stages):
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == stages[-1][1]


def test_empty_and_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    rows = [(None, None, None, None, None, "x"), (1, "", "en", "a", 0, "x"), (2, "word " * 20000, "en", "a", 1, "x"), (2, "word " * 20000, "en", "a", 1, "x")]
    for some in ([], rows):
        docs = spark.createDataFrame(some, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert last.count() == docs.count()
