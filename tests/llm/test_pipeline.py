import hashlib
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline as P
import numpy as np
import pytest
from test_jaccard import corpus, plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en" if i % 9 else None, f"s{i % 4}" if i % 11 else None, len(t or "")) for i, (d, t) in enumerate(rows)], SCHEMA)


def test_stages_against_brute_force(spark):
    rows = corpus(7, 120)
    docs = frame(spark, rows).cache()
    kept = P.language_id(spark, docs, "").cache()
    assert kept.columns == docs.columns
    letters = {d for d, t in rows if t and any(c.isalpha() for c in t)}
    assert {r.doc_id for r in kept.collect()} == letters
    texts = {r.doc_id: r.text for r in kept.collect()}
    one = P.near_duplicates(spark, kept, "").cache()
    want = {d for d, _, c in plain(sorted(texts.items()), P.NEAR) if d == c}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == want
    cut = P.repeated_passages(spark, one, "").cache()
    assert cut.columns == docs.columns
    for r in cut.collect():
        assert r.n_chars == len(r.text) and r.text.split()
    assert sum(r.n_chars for r in cut.collect()) < sum(r.n_chars for r in one.collect())
    mixed = P.source_mix(spark, cut, "").cache()
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and max(times.values()) <= 3 and set(times) <= {r.doc_id for r in cut.collect()}
    packed = P.pack(spark, mixed, "").collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == times


def test_odd_rows_pass_all_stages(spark):
    rows = [(None, "null id with words"), (1, None), (2, ""), (3, "same text here now"), (3, "same text here now"), (3, "another text"), (4, "été " * 60), (5, "123")]
    docs = frame(spark, rows)
    for _, stage in P.STAGES:
        docs = P.C.stash(stage(spark, docs, ""), "odd")
    assert docs.count() > 0
    docs = frame(spark, rows).limit(0)
    for _, stage in P.STAGES:
        docs = P.C.stash(stage(spark, docs, ""), "empty")
    assert docs.count() == 0


def test_run_on_a_table(spark, tmp_path):
    frame(spark, corpus(8, 60)).write.parquet(f"{tmp_path}/documents.parquet")
    got = P.run(spark, str(tmp_path))
    assert got.count() > 0 and got.columns[:2] == ["doc_id", "piece"]


def test_null_and_repeated_ids_keep_their_own_texts(spark):
    words = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    near = words(1) + " more"
    rows = [(None, words(0)), (None, words(1)), (None, None), (3, near), (3, words(3)), (3, words(3)), (4, words(4)), (4, words(5)), (5, words(4) + " end"), (6, words(6))]
    docs = frame(spark, rows).withColumn("source", P.F.lit("a"))
    # `near` goes with the second row, row 8 with one text of id 4, the repeated row with its like.
    want = Counter([(None, words(0)), (None, words(1)), (None, None), (3, words(3)), (4, words(4)), (4, words(5)), (6, words(6))])
    one = P.C.stash(P.near_duplicates(spark, docs, ""), "one")
    assert one.columns == docs.columns and Counter((r.doc_id, r.text) for r in one.collect()) == want
    mixed = P.source_mix(spark, one, "")  # the only source is taken once
    assert mixed.columns == docs.columns and Counter((r.doc_id, r.text) for r in mixed.collect()) == want - Counter([(None, None)])
    again = P.source_mix(spark, docs.where("text is not null"), "")
    assert Counter((r.doc_id, r.text) for r in again.collect()) == Counter(r for r in rows if r[1])


def plain_cut(rows, length=100):
    """What repeated_passages() leaves of (doc_id, text), by looking every window up."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        left = bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", "ignore") if len(raw) else ""
        if re.search(r"[^\x20\x09-\x0D]", left):
            out[d] = left
    return out


def plain_mix(rows):
    """Times that source_mix() takes each of (doc_id, text, source): whole epochs, then in key order while a document's middle
    lies within the budget."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows}
    by = defaultdict(list)
    for d, t, s in rows:
        by[s].append((int(hashlib.md5(str(d).encode()).hexdigest()[:13], 16), d))
    sources = sorted(by, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[d] for _, d in by[s]) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, open_, left = {}, set(sources), float(sum(total.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * total[s]
            open_.remove(s)
            left -= target[s]
    out = Counter()
    for s in sources:
        epochs = int(target[s] // total[s]) if total[s] else 0
        budget, at = round(target[s] - epochs * total[s]), 0
        for _, d in sorted(by[s]):
            times = epochs + (epochs < 3 and at + size[d] / 2 <= budget)
            at += size[d]
            if size[d] and times:
                out[d] = times
    return out


def test_cuts_and_mix_against_brute_force(spark):
    rows = [(d, t) for d, t in corpus(9, 90) if t]
    docs = frame(spark, rows).cache()
    cut = P.C.stash(P.repeated_passages(spark, docs, ""), "cut")
    assert {r.doc_id: r.text for r in cut.collect()} == plain_cut(rows)
    kept = cut.collect()
    mixed = Counter(r.doc_id for r in P.source_mix(spark, cut, "").collect())
    assert mixed == plain_mix([(r.doc_id, r.text, r.source) for r in kept])


def test_pack_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.packing.default_tokenizer())
    tok.encode_special_tokens = True
    rows = corpus(10, 40)
    got = defaultdict(list)
    places = defaultdict(list)
    for r in P.pack(spark, frame(spark, rows), "").collect():
        got[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for d, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = [ids[i : i + 2048] for i in range(0, len(ids), 2048)]
        want = [(n, n * 2048, len(p), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p))) for n, p in enumerate(pieces)]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got[d]) == want
    for spans in places.values():
        ends = [0, *np.cumsum([n for _, n in sorted(spans)])]
        assert [o for o, _ in sorted(spans)] == ends[:-1] and ends[-1] <= 2048


def test_extra_columns_and_long_texts(spark):
    rows = corpus(11, 40) + [(9000, "long " * 200_000), (9001, " ".join(f"u{i}" for i in range(100_000)))]
    docs = frame(spark, rows)
    clash = ("_d", "_h", "_row", "taken", "size", "component_id", "spans", "lang_pred", "row_number")
    wide = docs.select("*", *(P.F.lit("x").alias(c) for c in clash))
    for name, stage in P.STAGES[:-1]:
        docs, wide = P.C.stash(stage(spark, docs, ""), name), P.C.stash(stage(spark, wide, ""), name)
        assert wide.columns == [*docs.columns, *clash]
        assert Counter((r.doc_id, r.text) for r in wide.collect()) == Counter((r.doc_id, r.text) for r in docs.collect()), name
    assert P.pack(spark, wide, "").count() == P.pack(spark, docs, "").count()


@pytest.mark.parametrize("n", range(7))
def test_one_short_document(spark, n):
    docs = frame(spark, [(1, " ".join(f"w{i}" for i in range(n)))])
    assert P.near_duplicates(spark, docs, "").count() == 1
