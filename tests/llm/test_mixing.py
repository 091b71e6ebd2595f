import random
from collections import defaultdict

import pytest

from barograph.llm import mixing as M


def water(sizes):
    """Targets by plain repetition of the rule."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weight.items() if s not in capped}
        share = {s: (total - sum(capped.values())) * w / sum(rest.values()) for s, w in rest.items()}
        over = {s: 3.0 * sizes[s] for s in share if share[s] > 3 * sizes[s]}
        if not over:
            return share | capped
        capped |= over


@pytest.mark.parametrize("whole", [False, True])
def test_targets_and_budgets(spark, whole):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", "é", "Z", None, "tiny", "big", "big", "big"]), "w " * rng.randint(0, 80)) for i in range(400)]
    rows += [(1000 + i, "tiny2", "a b") for i in range(3)] + [(2000, "none", None), (2001, "none", " \t "), (7, "a", "x y"), (7, "a", "x y")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, source string, text string, size string")
    got = M.mix_documents(docs, whole=whole).collect()
    assert len(got) == len(rows)
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for _, source, text in rows:
        sizes[source] += len((text or "").split())
    for r in got:
        taken[r.source] += r.taken
        targets[r.source] = r.target
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
    want = water(sizes)
    for s in sizes:
        assert targets[s] == pytest.approx(want[s])
        assert abs(taken[s] - targets[s]) <= (40 if whole else 1)
    again = M.mix_documents(docs.repartition(7), whole=whole).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_many_sources_take_the_shuffled_join(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"s{i % 30}", "a b c") for i in range(90)], "doc_id long, source string, text string")
    one = sorted(map(str, M.mix_documents(docs).collect()))
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 3)
    assert one == sorted(map(str, M.mix_documents(docs).collect()))


def test_empty(spark):
    assert M.mix_documents(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
