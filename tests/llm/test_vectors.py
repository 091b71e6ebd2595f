import math
from collections import defaultdict

import numpy as np
import pytest

from barograph.llm import vectors as V


def plain(rows, cosine):
    def ok(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            (a, v, la), (b, w, lb) = rows[i], rows[j]
            if la is None or la != lb or a is None or b is None or not ok(v) or not ok(w) or len(v) != len(w):
                continue
            v, w = np.array(v, float), np.array(w, float)
            if v @ w / math.sqrt((v @ v) * (w @ w)) >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    return sorted(((r[0], links[i], min(least[find(i)]) if len(least[find(i)]) > 1 else r[0]) for i, r in enumerate(rows)), key=str)


def corpus(seed, n, width):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            base = rows[rng.integers(len(rows))][1]
            v = np.array(base) + rng.standard_normal(width) * rng.choice([0, 0.02, 0.05, 0.08]) if rng.random() < 0.9 else np.array(base) * 3
        else:
            v = rng.standard_normal(width) / math.sqrt(width)
        rows.append((i * 2 + 1, [float(np.float32(x)) for x in v], int(rng.integers(0, 3)) if rng.random() < 0.95 else None))
    bad = [None, [], [0.0] * width, [float("nan")] * width, [None] * width, [1.0] * (width + 1), [-0.0] * width, [float("inf")] + [1.0] * (width - 1)]
    return rows + [(1000 + i, b, 1) for i, b in enumerate(bad)] + [(None, rows[0][1], rows[0][2])]


@pytest.mark.parametrize(("seed", "n", "width", "chunk", "few"), [(1, 300, 16, 2048, 500), (2, 300, 10, 7, 0), (3, 200, 3, 20, 0), (4, 120, 1, 5, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, n, width, chunk, few):
    monkeypatch.setattr(V, "CHUNK", chunk)
    monkeypatch.setattr(V, "FEW", few)
    rows = corpus(seed, n, width)
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, component_id string").repartition(4)
    got = V.near_vectors(frame).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == plain(rows, 0.93)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_repeated_ids(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, a, 1), (5, a, 1), (5, b, 1), (6, b, 1), (7, a, 2)]
    got = V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(5, 1, 5), (5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 0, 7)]
    assert V.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_a_pair_at_the_edge_of_a_block_counts_once(spark):
    """Pairs whose block gap lies just over, at and under the block's share of the budget."""
    width, cosine = 64, 0.93
    share = (2 - 2 * cosine) / V.BLOCKS
    rows, turn = [], V.rotation(width)
    for n, over in enumerate((-1e-9, 0.0, 5e-10, 1e-9, 1e-6, 1e-3)):
        x = np.zeros(width)
        x[-1] = 1.0
        y = x.copy()
        y[0] += math.sqrt(share + over)
        y[20] += 0.05
        rows += [(2 * n, (x @ turn.T).tolist(), n), (2 * n + 1, (y @ turn.T).tolist(), n)]
    got = V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cosine).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == plain(rows, cosine)
    assert {r.n_links for r in got} == {1}


def test_dense_groups_and_long_vectors(spark, monkeypatch):
    monkeypatch.setattr(V, "CHUNK", 50)
    monkeypatch.setattr(V, "BATCH", 16)
    monkeypatch.setattr(V, "SAMPLE", 64)
    rng = np.random.default_rng(7)
    centre = rng.standard_normal(64)
    rows = [(i, (centre + rng.standard_normal(64) * 0.2).tolist(), 1) for i in range(300)]
    rows += [(1000 + i, rng.standard_normal(1024).tolist(), 1) for i in range(20)]
    rows += [(2000 + i, (np.array(rows[300 + i][1]) * (1 + 0.01 * i)).tolist(), 1) for i in range(20)]
    got = V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == plain(rows, 0.93)
