import hashlib
import random

import numpy as np
import pytest

from barograph.llm import suffixes as S


def plain(rows, length):
    """Brute force: every window of every text, in order."""
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(b"" if r[1] is None else b"t" + r[1].encode()).hexdigest()))
    seen, out = set(), {}
    for key, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        left = bytes(np.frombuffer(raw, np.uint8)[~gone]) if len(raw) else b""
        runs = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out.setdefault((key, len(raw), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()), 0)
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "été", "x", "ga", "delta9", "…", "zz"]) + str(rng.randint(0, 300))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(rng.randint(10, 60)) for _ in range(5)]
    rows = []
    for i in range(n):
        t = text(rng.randint(0, 80))
        if rng.random() < 0.6:
            t = t[: rng.randint(0, len(t))] + rng.choice(passages) + text(rng.randint(0, 30))
        if rows and rng.random() < 0.3:
            t = rows[rng.randrange(len(rows))][1] or ""
            if rng.random() < 0.6 and t:
                p = rng.randrange(len(t))
                t = t[:p] + "#" + t[p + rng.randint(0, 3) :]
        rows.append((rng.randrange(10**6) * 200 + i, t))
    return [*rows, (1, "a" * 700), (3, "a" * 350 + "b"), (5, None), (7, ""), (9, "ab" * 300), (11, "x" * 99), (13, "x" * 100), (15, "x" * 100)]


@pytest.mark.parametrize(("seed", "group", "frequent"), [(1, 4096, 8), (2, 3, 8), (3, 4096, 0), (4, 1, 8)])
def test_equals_brute_force(spark, monkeypatch, seed, group, frequent):
    monkeypatch.setattr(S, "GROUP", group)
    monkeypatch.setattr(S, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(S.C, "CHUNK_BYTES", 5_000)
    if not frequent:
        everything = lambda docs, length, k: np.sort(np.unique(np.concatenate([S.cells(np.frombuffer(r.text.encode(), np.uint8), np.array([0, len(r.text.encode())]), length, k)[4] for r in docs.where("text is not null").collect()])))
        monkeypatch.setattr(S, "frequent_anchors", everything)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_bytes string").repartition(5)
    got = S.strip_repeats(docs).collect()
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == set(plain(rows, 100))
    assert len(got) == len(rows)


def test_null_and_repeated_ids(spark):
    long = "one two three " * 30
    rows = [(None, long), (None, None), (2, long), (2, long), (2, long + "!"), (3, "é" * 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.strip_repeats(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == set(plain(rows, 100))
    assert S.strip_repeats(docs.limit(0)).count() == 0


def test_sort_is_a_suffix_sort():
    rng = np.random.default_rng(0)
    buf = rng.integers(97, 99, 600).astype(np.uint8)
    at = rng.permutation(500)
    segment = np.sort(rng.integers(0, 7, 500))
    order = S.sort_suffixes(S.Suffixes(buf, 100), at, segment)
    want = sorted(range(500), key=lambda i: (segment[i], bytes(buf[at[i] : at[i] + 100]), i))
    assert order.tolist() == want


def test_collisions_are_verified(monkeypatch):
    monkeypatch.setattr(S.Suffixes, "extension", lambda self, x, y: np.full(len(x), self.length))
    buf = np.frombuffer(b"a" * 100 + b"b" * 100 + b"a" * 100, np.uint8)
    one = np.ones(3, np.int64)
    cell, j = S.repeats_in(buf, one, np.array([0, 100, 200]), one, 0 * one, np.array([1, 2, 3]), 0 * one, 100)
    assert (cell.tolist(), j.tolist()) == ([2], [0])


def test_cells_that_share_a_polynomial_hash_are_told_apart(spark, monkeypatch):
    """Whatever the polynomial hashes say, cells of other bytes are no repeats."""
    honest = S.cells

    def colliding(*args):
        *rest, whole, digest = honest(*args)
        return *rest, np.zeros_like(whole), digest

    monkeypatch.setattr(S, "cells", colliding)
    rows = corpus(6, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = S.strip_repeats(docs).collect()
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == set(plain(rows, 100))


def test_very_long_text(spark):
    rng = random.Random(8)
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))
    rows = [(1, base), (2, base[100_000:300_000] + "x" + base), (3, "z" * 300_000)]
    got = S.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == set(plain(rows, 100))


@pytest.mark.parametrize(("seed", "group", "held", "batch"), [(5, 4096, 3, 7), (6, 2, 1 << 20, 7), (7, 4096, 1 << 20, 3)])
def test_open_groups_equal_brute_force(spark, monkeypatch, seed, group, held, batch):
    monkeypatch.setattr(S, "GROUP", group)
    monkeypatch.setattr(S, "HELD", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = corpus(seed)
        got = S.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == set(plain(rows, 100))


@pytest.mark.parametrize("length", [99, 100])
def test_cells_that_share_a_window_share_a_side(length):
    rng = random.Random(length)
    words = lambda n: "".join(rng.choice(["ab", "ba", "c", "é"]) for _ in range(n)).encode()
    passages = [words(rng.randint(60, 90)) for _ in range(20)]
    texts = [words(rng.randint(0, 60)) + rng.choice(passages) + words(rng.randint(0, 60)) for _ in range(300)]
    buf, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    row, start, windows, place, anchor, cell, digest, side = S.cells(buf, offs, length, S.K)
    group = np.unique(anchor, return_inverse=True)[1]
    asked = S.shares_side(group, side)
    holders = {}
    for i, (r, s, n) in enumerate(zip(row.tolist(), start.tolist(), windows.tolist(), strict=True)):
        for w in range(s, s + n):
            holders.setdefault(texts[r][w : w + length], set()).add(i)
    shared = {i for cells in holders.values() if len(cells) > 1 for i in cells}
    assert shared and asked[list(shared)].all()


def test_anchors_shared_by_chance_are_not_asked_for(spark):
    rng = random.Random(0)
    letters = lambda n: "".join(chr(rng.randint(97, 122)) for _ in range(n))

    def anchors(texts):
        offs = np.cumsum([0] + [len(t) for t in texts])
        return np.unique(S.cells(np.frombuffer("".join(texts).encode(), np.uint8), offs, 100, S.K)[4], return_counts=True)[1]

    grams = [letters(S.K) for _ in range(100)]
    gram = max(grams, key=lambda g: anchors([letters(200) + g + letters(200) for _ in range(20)]).max())  # the likeliest anchor
    texts = [letters(200) + gram + letters(200) for _ in range(400)]  # nothing else is shared
    assert anchors(texts).max() > 200
    none = np.zeros(0, np.uint64)
    docs = spark.createDataFrame(list(enumerate(texts)), "_d long, text string")
    assert S.settle_cells(S.block_cells(docs, none, 100, S.K), none).count() == 0
