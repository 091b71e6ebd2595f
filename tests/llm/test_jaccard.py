import random
import re
from collections import defaultdict

import pytest

from barograph.llm import jaccard as J
from barograph.llm.components import components


def shingle_set(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def plain(rows, rule):
    sets = [shingle_set(t, rule.words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and rule.den * both >= rule.num * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted((d, len(sets[i]), min(least[find(i)])) for i, (d, _) in enumerate(rows))


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randint(0, 400))
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            base = (rng.choice(rows)[1] or "x").split(" ")
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                base[rng.randrange(len(base))] = word()
            if rng.random() < 0.3:
                base += [word() for _ in range(rng.randint(0, len(base) // 6))]
        else:
            base = [word() for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 8, 15, 60, 200, 700]))]
            if rng.random() < 0.4:
                base = base[: rng.randint(0, 60)] + passage
        text = " ".join(base)
        rows.append((i * 3 + 1, text.upper() if rng.random() < 0.1 else text))
    return [*rows, (5000, None), (5001, ""), (5002, " \n"), (5003, "Å x"), (5004, "å x"), (5005, "one"), (5006, "ONE  ")]


@pytest.mark.parametrize(("seed", "n", "small", "words", "num"), [(1, 150, 6, 4, 85), (2, 300, 2, 4, 85), (3, 120, 2, 5, 80), (4, 80, 3, 2, 60)])
def test_equals_brute_force(spark, monkeypatch, seed, n, small, words, num):
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "UNIT", 5)
    monkeypatch.setattr(J, "CHUNK", 4)
    rule = J.Rule(words, num)
    rows = corpus(seed, n)
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component_id string").repartition(5)
    got = J.near_duplicates(docs, rule).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(rows, rule)


def test_open_segments_get_a_second_look(spark, monkeypatch):
    """A first document that shares segments with two groups, but links with neither."""
    monkeypatch.setattr(J, "SMALL", 2)
    rng = random.Random(0)
    base = [f"b{i}" for i in range(120)]
    rows = [(0, " ".join(base[:60] + [f"z{i}" for i in range(60)]))]
    for i in range(1, 30):
        edited = list(base)
        for _ in range(3):
            edited[rng.randrange(60, 120)] = f"e{i}"
        rows.append((i, " ".join(edited)))
    rule = J.Rule(4, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(docs, rule).collect()) == plain(rows, rule)


def test_null_and_repeated_ids(spark):
    t = " ".join(f"w{i}" for i in range(50))
    rows = [(None, t), (2, t), (2, t), (2, "other text that stands alone"), (7, t + " end"), (7, None)]
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), J.Rule(4, 85)).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted([("None", 47, "None"), ("2", 47, "None"), ("2", 47, "None"), ("2", 2, "2"), ("7", 48, "None"), ("7", 0, "7")])
    assert J.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), J.Rule(4, 85)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (300, 200), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}


def test_sketches_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 5, 300, 2000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n * 9 // 10], rng.integers(0, 1 << 63, n // 5, dtype=np.uint64)]))
        far = J.hamming(J.parity_sketch(a), J.parity_sketch(b))
        assert far <= len(np.setxor1d(a, b))
        assert J.hamming(J.parity_sketch(a), J.parity_sketch(a)) == 0
    assert J.hamming(J.folded(J.parity_sketch(a), 64), J.parity_sketch(a)) == 0


def test_one_short_document_a_chunk():
    """Chunks of fewer words than a shingle."""
    import numpy as np

    for words in (4, 5):
        for n in range(7):
            text = " ".join(f"w{i}" for i in range(n)).encode()
            row, hashes = J.shingles(np.frombuffer(text, np.uint8), np.array([0, len(text)]), words)
            assert len(hashes) == len(row) == (max(1, n - words + 1) if n else 0)


@pytest.mark.parametrize("words", [4, 5])
def test_one_document_a_partition(spark, words):
    rows = [(n, " ".join(f"w{i}" for i in range(n))) for n in range(7)]
    rows += [(n + 10, t.upper()) for n, t in rows]
    rule = J.Rule(words, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(14, "doc_id")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(docs, rule).collect()) == plain(rows, rule)


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n)), "".join("ba"[i.bit_count() % 2] for i in range(n))


def test_words_built_to_collide_do_not_link(spark):
    one, other = thue_morse(2048)
    shared = " ".join(f"s{i}" for i in range(5))
    rows = [(1, f"{one} {shared}"), (2, f"{other} {shared}"), (3, one), (4, other)]
    rule = J.Rule(4, 85)
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rule).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(rows, rule)


def test_collisions_of_the_first_hash_are_told_apart():
    import numpy as np

    u = lambda *x: np.array(x, np.uint64)
    assert J.shared_shingles((u(1, 2, 3), u(7, 8, 9)), (u(1, 2, 4), u(7, 0, 9))) == 1
    assert J.shared_shingles((u(1, 1, 3), u(6, 7, 9)), (u(1, 3), u(7, 9))) == 2
    assert J.shared_shingles((u(), u()), (u(1), u(1))) == 0


def test_very_long_text(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(3000)}" for _ in range(200_000)]
    edited = list(base)
    for i in range(0, len(base), 400):
        edited[i] = "edit"
    rows = [(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(base[: len(base) // 2])), (4, "x" * 1_000_000), (5, "X" * 1_000_000)]
    rule = J.Rule(4, 85)
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rule).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(rows, rule)
