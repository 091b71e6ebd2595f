import random
import zlib

import numpy as np
import pytest

from barograph.llm import language as L
from pyspark.sql import functions as F

PARTS = {"aa": ["the", "ing", "th", "an", "er"], "bb": ["der", "sch", "ung", "ei", "ü"], "cc": ["que", "eau", "le", "é", "oi"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, rng.randint(3, 60)), lang) for i in range(300) for lang in [rng.choice(list(PARTS))]]
    rows += [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "", None), (1003, text(rng, "bb", 30), None), (None, text(rng, "cc", 30), "cc"), (4, text(rng, "aa", 9), "aa"), (4, text(rng, "aa", 9), "aa")]
    return spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")


def test_held_out_accuracy(spark, docs):
    fold = F.coalesce(L.fold_of(F.col("doc_id")) == 1, F.lit(False))
    names, model = L.learn(docs.where(~fold))
    assert names == ["aa", "bb", "cc"]
    got = L.identify(docs.withColumn("held", fold), names, model).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    clean = [r for r in got if r.held and r.doc_id < 1000]
    assert sum(r.lang == r.lang_pred for r in clean) >= 0.98 * len(clean)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert by_id[1001].score == 0.0 and by_id[1003].lang_pred == "bb"


def test_mixture_of_languages(spark, docs):
    names, model = L.learn(docs)
    rng = random.Random(2)
    both = text(rng, "aa", 70) + " " + text(rng, "cc", 30)
    pure = text(rng, "bb", 80)
    got = L.identify(spark.createDataFrame([(1, both), (2, pure)], "doc_id long, text string"), names, model).orderBy("doc_id").collect()
    assert got[0].lang_pred == "aa" and [s.lang for s in got[0].lang_set] == ["aa", "cc"]
    assert got[0].score == pytest.approx(0.7, abs=0.07)
    assert [s.lang for s in got[1].lang_set] == ["bb"] and got[1].score == 1.0


def test_counts_are_sums_over_all_documents(spark, docs):
    one = L.learn(docs.coalesce(1))
    many = L.learn(docs.repartition(9))
    assert one[0] == many[0] and np.array_equal(one[1], many[1])


def test_nothing_learned(spark, docs):
    names, model = L.learn(docs.where("lang is null"))
    assert names == []
    assert {r.lang_pred for r in L.identify(docs, names, model).collect()} == {"und"}
    assert L.identify(docs.limit(0), names, model).count() == 0


def test_likelihood_grows():
    rng = np.random.default_rng(0)
    likely = rng.random((50, 3))
    values = [L.mixtures(likely, np.array([0, 20]), np.ones((2, 3)), s)[1] for s in range(6)]
    assert all((b >= a - 1e-9).all() for a, b in zip(values, values[1:]))


def plain_grams(text):
    """(first bucket, second bucket) of each letter of each word, by the definition: three and four bytes around it."""
    raw = [b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in text.encode()]
    words, out = bytes(raw).split(b" "), []
    for word in words:
        if word:
            padded = b"  " + word + b" "
            near = []
            for i in range(2, len(padded) - 1):
                three = int.from_bytes(padded[i - 1 : i + 2], "big")
                four = three | (padded[i - 2] << 24)
                near.append((((three + 1) * 2654435761 % 2**32) >> 17, (((four ^ (four >> 15)) + 7) * 2246822519 % 2**32) >> 17))
            out.append(near)
    return out


def plain_model(rows):
    import math
    from collections import Counter

    counts = {}
    for text, lang in rows:
        if text is not None and lang is not None:
            for word in plain_grams(text):
                for three, four in word:
                    counts.setdefault(lang, Counter()).update([(0, three), (1, four)])
    sums = {lang: [sum(v for (o, _), v in c.items() if o == order) for order in (0, 1)] for lang, c in counts.items()}
    return lambda lang, order, bucket: math.log((counts[lang][order, bucket] + L.SMOOTHING) / (sums[lang][order] + L.SMOOTHING * L.BUCKETS)), sorted(counts)


def plain_mixture(likely, subset, steps):
    import math

    share = dict.fromkeys(subset, 1 / len(subset))
    for step in range(steps + 1):
        joint = [{m: w[m] * share[m] for m in subset} for w in likely]
        total = sum(math.log(max(sum(j.values()), 1e-300)) for j in joint)
        last = share
        share = {m: sum(j[m] / sum(j.values()) for j in joint) / len(likely) for m in subset}
    return total, last


def plain_predict(text, log, names):
    """The best penalised set of all sets of languages."""
    import itertools
    import math

    words = plain_grams(text or "")
    if not words:
        return "und", 0.0
    scores = [{m: sum(log(m, 0, a) + log(m, 1, b) for a, b in w) / L.OVERLAP for m in names} for w in words]
    likely = [{m: math.exp(v - max(s.values())) for m, v in s.items()} for s in scores]
    best = None
    for size in range(1, len(names) + 1):
        for subset in itertools.combinations(names, size):
            total, share = plain_mixture(likely, subset, L.EM_STEPS)
            value = total - L.PENALTY * (size - 1) * 0.5 * math.log(len(words) + 1)
            if best is None or value > best[0] + 1e-9:
                best = (value, max(share, key=lambda m: (share[m], [-ord(c) for c in m])), share)
    return best[1], best[2][best[1]]


def test_equals_brute_force(spark):
    rng = random.Random(11)
    langs = list(PARTS)
    train = [(text(rng, lang, 40), lang) for _ in range(20) for lang in langs] + [(None, "aa"), ("x", None)]
    log, names = plain_model(train)
    rows = [" ".join(text(rng, lang, rng.randint(0, 40)) for lang in rng.sample(langs, rng.randint(1, 3))) for _ in range(60)] + [None, "", "12 %", "ÉTÉ Über", "q" * 50]
    learned = L.learn(spark.createDataFrame(train, "text string, lang string"))
    assert learned[0] == names
    got = L.identify(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), *learned).collect()
    for r in got:
        pred, score = plain_predict(rows[r.doc_id], log, names)
        assert r.lang_pred == pred and r.score == pytest.approx(score, abs=1e-4), rows[r.doc_id]


def test_a_set_may_hold_many_languages():
    rng = np.random.default_rng(3)
    k = 8
    for size in (1, 5, 7):
        of = np.repeat(np.arange(size), 60)
        logs = rng.uniform(-9, -6, (len(of), k))
        logs[np.arange(len(of)), of] = 0.0
        chosen = L.select_languages(logs, np.array([0]))
        assert np.flatnonzero(chosen[0]).tolist() == list(range(size))
        assert np.allclose(chosen[0, :size], 1 / size, atol=0.02)


def test_very_long_text(spark, docs):
    names, model = L.learn(docs)
    rng = random.Random(5)
    rows = [(1, text(rng, "bb", 120_000)), (2, "a" * 1_000_000), (3, " " * 1_000_000)]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string"), names, model).collect()}
    assert got[1].lang_pred == "bb" and got[1].score == 1.0 and got[2].lang_pred in names and got[3].lang_pred == "und"
