import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barograph.llm import topk as T


def plain(rows, k, step):
    good = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in good.items():
        if q % step == 0:
            hits = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good.items() if i != q and len(b) == len(a))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "shard", "possible"), [(1, 8192, 0.02), (2, 40, 0.5), (3, 25, 1.0)])
def test_equals_brute_force(spark, monkeypatch, seed, shard, possible):
    monkeypatch.setattr(T, "SHARD", shard)
    monkeypatch.setattr(T, "POSSIBLE", possible)
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.standard_normal(12) * rng.choice([0.01, 1, 30])]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(30)]
    rows += [(1000, None), (1005, []), (1010, [None] * 12), (1015, [float("nan")] * 12), (1020, [1.0, 2.0]), (None, rows[0][1])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in T.top_k(frame, F.col("vec_id") % 5 == 0, 5).collect())
    assert got == plain(rows, 5, 5)


def test_stops_on_proof_before_the_last_segment():
    rng = np.random.default_rng(0)
    values = np.floor(rng.standard_normal((2000, 8)) * 3)
    values[:20, 0] = 5000 + np.arange(20)
    shard = T.Shard(np.arange(2000), values)
    shard.segments[-1] = None  # reaching the last segment would fail
    q, r, score = shard.search(values[:3], np.arange(3), 5)
    want = values[:3] @ values.T
    want[np.arange(3), np.arange(3)] = -np.inf
    assert [sorted(score[q == i].tolist(), reverse=True) for i in range(3)] == [sorted(w, reverse=True)[:5] for w in want.tolist()]


def test_large_values_and_empty(spark):
    rows = [(0, [1e9, 2.0]), (5, [3e9, -1.0]), (6, [-1e9, 0.5])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in T.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0, 5).collect())
    big = 2**63 - 1
    assert [(q, n, i, max(min(s, big), -big - 1)) for q, n, i, s in plain(rows, 5, 5)] == got
    assert T.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 5 == 0).count() == 0


def test_exact_products_of_any_size():
    rng = np.random.default_rng(5)
    for dims, size in ((8, 100.0), (8, 2.0**40), (40, 2.0**51), (600, 2.0**30), (600, 1000.0), (4, 2.0**80)):
        a, b = (np.floor(rng.standard_normal((6, dims)) * size / 8) for _ in range(2))
        q, r = (x.ravel() for x in np.indices((6, 6)))
        high, low, score = T.exact_products(a, b, q, r)
        want = [sum(int(x) * int(y) for x, y in zip(a[i], b[j])) for i, j in zip(q, r)]
        assert score.tolist() == [max(-(2**63), min(2**63 - 1, w)) for w in want]
        assert sorted(range(36), key=lambda i: (high[i], low[i])) == sorted(range(36), key=lambda i: want[i])


def test_sparse_and_dense_segments_add_up():
    rng = np.random.default_rng(6)
    values = rng.standard_normal((50, 6)).astype(np.float32)
    queries = rng.standard_normal((6, 7)).astype(np.float32)
    for share in (0.02, 0.5):
        chosen = rng.random((50, 6)) < share
        score = np.zeros((50, 7), np.float32)
        segment = T.Postings(values, chosen)
        assert (segment.block is None) == (chosen.sum() < T.FULL * 300)
        segment.add(score, queries)
        assert np.allclose(score, np.where(chosen, values, 0) @ queries, atol=1e-5)


def test_long_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.standard_normal(1500)]) for i in range(40)]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in T.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0, 5).collect())
    assert got == plain(rows, 5, 5)
