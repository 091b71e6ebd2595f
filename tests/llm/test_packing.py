import random
import zlib
from collections import defaultdict

import pytest

from barograph.llm import packing as P


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.default_tokenizer())
    t.encode_special_tokens = True
    return t


TEXTS = ["", None, "Hello, World!  It's 12 o'clock\n\n\tÉté ß ñ \x1f\x85 a\u0301b", "x " * 5000, "dup", "dup", "a" * 3000, "\u3000wide\u2003space", "'s't 're", "<|endoftext|> ok", "İstanbul ΑΣ ΑΣ.", "a's!s ''t 'll,x x'S l'été,été're a=\u0338b 3rd 3's [a]b… …! é!é \u01c5 J\u030cj \ua7c2 \U0001f600ok"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "junk", i) for i, t in enumerate(texts)], "doc_id long, text string, length string, offset int")


def test_ids_places_and_gaps(spark, plain):
    rows = P.pack(P.C.stash(P.tokenize_pieces(docs(spark), P.default_tokenizer(), with_ids=True), "t")).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) == r.ids_crc32
    for i, text in enumerate(TEXTS):
        want = plain.encode(text or "", add_special_tokens=False).ids + [0]
        got = sorted(by_doc[i], key=lambda r: r.piece)
        assert [x for r in got for x in r.ids] == want, text
        assert [r.start for r in got] == list(range(0, len(want), 2048))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    full = P.sequences(spark.createDataFrame(rows)).collect()
    assert sum(len(r.ids) for r in full) == sum(r.length for r in rows)


def plain_best_fit(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, c in enumerate(left) if c >= n]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= n
        else:
            left.append(capacity - n)
    return sorted(left)


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_item_by_item_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 200])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 300))]
    if seed % 3 == 0:
        lengths += [rng.randint(1, capacity)] * 200
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan = P.best_fit_decreasing(histogram, capacity)
    ends, ranks = defaultdict(list), defaultdict(list)
    steps = list(zip(plan.length, plan.rank, plan.bin, plan.each, plan.offset, strict=True))
    for k, (n, rank, first, each, offset) in enumerate(steps):
        stop = min([s[1] for s in steps if s[0] == n and s[1] > rank], default=histogram[n])
        for j in range(rank, stop):
            ends[first + (j - rank) // each].append((offset + (j - rank) % each * n, n))
    assert sum(map(len, ends.values())) == len(lengths)
    left = []
    for places in ends.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        left.append(capacity - at)
    assert sorted(left) == plain_best_fit(lengths, capacity)


def test_tree():
    tree = P.CapacityTree(10)
    tree.add(3, 1)
    tree.add(9, 2)
    assert [tree.tightest(x) for x in (0, 3, 4, 9, 10)] == [3, 3, 9, 9, -1]


def test_empty(spark):
    assert P.pack_documents(docs(spark).limit(0), P.default_tokenizer()).count() == 0


def test_cache_restarts(spark, plain, monkeypatch):
    import numpy as np

    monkeypatch.setattr(P, "WORD_CACHE", 3)
    tok = P.WordTokenizer(P.default_tokenizer())
    for text in ("one two three four five", "six one", "two seven eight"):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert tok.encode(raw, np.array([0, len(raw)]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_words_built_to_collide(spark, plain):
    """Words whose polynomial hashes modulo 2**64 are equal for every odd base."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    other = "".join("ba"[i.bit_count() % 2] for i in range(2048))
    rows = P.tokenize_pieces(spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string").coalesce(1), P.default_tokenizer()).collect()
    for r, text in zip(sorted(rows, key=lambda r: (r.doc_id, r.piece)), (one, other), strict=True):
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in [*plain.encode(text, add_special_tokens=False).ids, 0]))


def test_a_shared_digest_is_told_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(P.C, "span_digests", lambda view, buf, start, end, salt=0: (end - start).astype(np.uint64))
    raw = np.frombuffer(b"ab cd ab xyz", np.uint8)
    first, back = P.distinct_spans(raw, np.array([0, 3, 6, 9]), np.array([2, 5, 8, 12]))
    assert back[0] == back[2] != back[1] and len(first) == 3 == len(set(back.tolist()))
    assert [raw[np.array([0, 3, 6, 9])[first[b]]] for b in back.tolist()] == list(b"acax")
