import random
import re

import pytest

from barograph.llm import licenses as N


def grams(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return set(zip(w, w[1:]))


def plain(text, dice):
    """The best license over all runs of words of one document."""
    words, best = re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), {}
    pairs = list(zip(words, words[1:]))
    for name, texts in N.TEMPLATES.items():
        for t in texts:
            want = grams(t)
            if 2 * len(set(pairs) & want) < dice * len(want):  # more than any run can make up for
                continue
            for i in range(len(pairs)):
                have, both = set(), 0
                for p in pairs[i:]:
                    both += p in want and p not in have
                    have.add(p)
                    v = 2 * both / (len(have) + len(want))
                    if v >= dice:
                        best[name] = max(best.get(name, 0), v)
    return min(((-v, n) for n, v in best.items()), default=(0.0, None))


@pytest.mark.parametrize("dice", [0.8, 0.5])
def test_equals_brute_force(spark, dice):
    rng = random.Random(3)
    pool = [t for texts in N.TEMPLATES.values() for t in texts]
    word = lambda: rng.choice(["the", "license", "under", "été", "foo", "version", "rights", "bar"])
    rows = [(0, None), (1, ""), (2, "license"), (3, "\n\n")]
    for i in range(4, 60):
        t = rng.choice(pool).split()
        for _ in range(rng.randint(0, 1 + len(t) // 12)):
            t[rng.randrange(len(t))] = word()
        if rng.random() < 0.5:
            for _ in range(rng.randint(1, 4)):
                t.insert(rng.randrange(len(t)), "\n")
        junk = [" ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 4))]
        junk.insert(rng.randint(0, len(junk)), " ".join(t))
        rows.append((i, "\n".join(junk)))
    got = {r.doc_id: r for r in N.scan_licenses(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, license string"), dice=dice).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        value, name = plain(text, dice)
        assert got[i].dice == pytest.approx(-value if name else 0.0) and got[i].license == name, text


def test_notices_inside_lines(spark):
    full = " ".join(N.TEMPLATES["BSD-3-Clause"][0].split())
    rows = [(1, f"some words before it {full} and after it, on one line"), (2, "x y all rights reserved z"), (3, f"{full}\n{full}")]
    got = {r.doc_id: (r.license, round(r.dice, 3)) for r in N.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("BSD-3-Clause", 1.0), 2: ("all-rights-reserved", 1.0), 3: ("BSD-3-Clause", 1.0)}


@pytest.mark.parametrize("line", ["All rights reserved.", "Released under an MIT License.", "licensed under the gnu general public license"])
def test_repeated_lines_take_linear_time(line):
    import time

    import numpy as np

    known = N.Templates(N.TEMPLATES, N.DICE)
    raw = np.frombuffer((line + "\n").encode() * 100_000, np.uint8)
    hashes = N.bigrams(raw, np.array([0, len(raw)]))[3]
    began = time.time()
    found = known.best_runs(hashes, known.places(hashes))
    assert time.time() - began < 10  # about a second when nothing else runs
    assert [f[0] for f in found] == {"A": ["all-rights-reserved"], "R": [], "l": []}[line[0]]


def test_lines_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b\n\nReleased under the MIT License.\nend of it"), (1, "x"), (None, "All rights reserved.")], "doc_id long, text string")
    rows = N.scan_licenses(docs).collect()
    assert [(x.license, x.first_line, x.last_line) for r in rows for x in r.licenses] == [("MIT", 2, 2), ("all-rights-reserved", 0, 0)]
    assert N.scan_licenses(docs.limit(0)).count() == 0
