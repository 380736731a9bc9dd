import math

import numpy as np
import pytest

from spanlens.llm.embedding_dedup import CrossPolytope, hadamard, near_vectors


def slow(rows, threshold=0.9):
    def usable(v):
        return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v)

    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if usable(a) and usable(b) and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    comp = [least.get(find(i)) for i in range(len(rows))]
    return sorted(((d, links[i], comp[i], d is not None and d == comp[i]) for i, (d, _) in enumerate(rows)), key=str)


def vectors(seed, width=32, groups=25):
    rng = np.random.default_rng(seed)
    rows = [(None, None), (1000, None), (1001, []), (1002, [0.0] * width), (1003, [None] + [1.0] * (width - 1)), (1004, [math.nan] + [1.0] * (width - 1)), (1005, [math.inf] + [1.0] * (width - 1)), (1006, [1.0, 0.0]), (1007, [1.0, 0.01])]
    for _ in range(groups):
        base = rng.normal(size=width)
        for _ in range(rng.integers(1, 7)):
            v = base + rng.normal(size=width) * rng.choice([0.0, 0.05, 0.2])
            rows.append((len(rows), np.float32(v).astype(float).tolist()))
    same = rows[-1][1]
    return rows + [(None, same), (2000, same), (2000, same), (2001, [2 * c for c in same])]


@pytest.mark.parametrize("seed, part", [(1, 8192), (2, 4)])
def test_equals_brute_force(spark, seed, part):
    rows = vectors(seed)
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    # many tables and probes: at this size the index must miss nothing
    got = near_vectors(frame, tables=12, probes=10, part=part).collect()
    assert sorted((tuple(r) for r in got), key=str) == slow(rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    n, width = 4000, 64
    a = rng.normal(size=(n, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise = rng.normal(size=(n, width))
    noise -= (noise * a).sum(1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    from spanlens.llm.embedding_dedup import PROBES, SEED, TABLES

    coder = CrossPolytope(width, TABLES, PROBES, SEED)
    for cosine, least in ((0.9, 0.9), (0.95, 0.97), (0.99, 0.999)):
        b = cosine * a + math.sqrt(1 - cosine**2) * noise
        ca, cb = coder.codes(a), coder.codes(b)
        met = (ca == cb[:, :, :1]).any((1, 2)) | (cb == ca[:, :, :1]).any((1, 2))
        print(cosine, met.mean())
        assert met.mean() >= least


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(hadamard(hadamard(x)), x)


def test_no_rows(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_vectors(frame).collect() == []


def test_table_recall(spark):
    """Links of the whole sf0.1 table against brute force: all found, none wrong."""
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.1/embeddings.parquet"
    x = np.array(pq.read_table(path)["embedding"].to_pylist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r.n_links for r in near_vectors(spark.read.parquet(path)).collect()}
    ids = pq.read_table(path)["vec_id"].to_pylist()
    have = np.array([got[i] for i in ids])
    assert (have <= want).all() and have.sum() >= 0.9 * want.sum()
