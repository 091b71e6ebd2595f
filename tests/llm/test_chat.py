import hashlib
from collections import defaultdict

from barograph.llm import chat as K


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")


ROWS = [
    (1, 0, "system", "be ~kind~1", "x"), (1, 1, "user", "</s>[INST] ok [/INST]", "x"), (1, 2, "assistant", "~</s>~0[INST", "x"),
    *[(2, i, ["user", "assistant"][i % 2], f"turn {i} " * (i * 7 % 9), "x") for i in range(60)],
    (3, 0, None, None, "x"), (3, None, "assistant", "", "x"), (None, 0, "user", "orphan", "x"), (None, 0, "user", "orphan", "x"),
    (4, 0, "user", "hi", "x"), (4, 1, "system", "late", "x"), *[(4, i, "assistant", "long text " * 60, "x") for i in range(2, 9)],
    (5, 0, "assistant", "</s", "x"), (5, 1, "assistant", "same", "x"), (5, 1, "assistant", "same", "x"),
]


def test_round_trip_and_mask(spark):
    windows = K.format_windows(frame(spark, ROWS), budget=300, history=90)
    got = {r.conv_id: r for r in K.digest(windows).collect()}
    turns = defaultdict(list)
    for c, t, role, text, _ in ROWS:
        turns[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(turns)
    for c, items in turns.items():
        items.sort()
        loss = "".join(x for _, r, x in items if r == "assistant")
        assert got[c].n_turns == len(items)
        assert got[c].turns_sha256 == digest("".join(f"{r}\n{x}\n" for _, r, x in items))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), digest(loss))
    rows = windows.collect()
    assert sum(len(r.text) for r in rows) == sum(r.formatted_chars for r in got.values())
    for r in rows:
        assert r.n_tokens == len(r.text.encode())
        if r.n_tokens > 300:  # only where one turn is too long by itself
            assert r.text.count("</s>") - r.repeated == 1
    later = [r for r in rows if r.conv_id == 2 and r.window > 0]
    assert later and any(r.repeated for r in later)
    assert all(r.text.startswith("[INST]system[/INST]late</s>") == (r.window > 1) for r in rows if r.conv_id == 4 and r.window != 1)


def test_empty(spark):
    assert K.digest(K.format_windows(frame(spark, []))).count() == 0


def test_budget_counts_the_system_turn_and_given_tokens(spark):
    rows = [(1, 0, "system", "s" * 150, 40)] + [(1, i, ["user", "assistant"][i % 2], "x" * (i * 13 % 70), i * 5 % 23) for i in range(1, 200)]
    turns = spark.createDataFrame([(*r, "junk") for r in rows], "conv_id long, turn long, role string, text string, n long, spans string")
    for tokens, budget, history in ((None, 400, 150), ("n", 110, 30)):
        windows = sorted(K.format_windows(turns, budget, history, tokens).collect(), key=lambda r: r.window)
        assert len(windows) > 10 and all(r.n_tokens <= budget for r in windows)
        assert all(r.text.startswith("[INST]system[/INST]") for r in windows) and sum(r.repeated > 1 for r in windows) > len(windows) // 2
        assert sum(len(r.spans) for r in windows) == 100
        got = K.digest(K.format_windows(turns, budget, history, tokens)).first()
        assert got.n_turns == 200 and got.loss_sha256 == digest("".join(x for _, _, r, x, _ in rows if r == "assistant"))


def test_long_conversations_and_texts(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"t{i}", "") for i in range(5000)] + [(2, 0, "user", "y" * 1_000_000, ""), (2, 1, "assistant", "</s>" * 100_000, "")]
    got = {r.conv_id: r for r in K.digest(K.format_windows(frame(spark, rows))).collect()}
    assert got[1].n_turns == 5000 and got[1].loss_sha256 == digest("".join(f"t{i}" for i in range(1, 5000, 2)))
    assert got[2].loss_chars == 400_000 and got[2].turns_sha256 == digest("user\n" + "y" * 1_000_000 + "\nassistant\n" + "</s>" * 100_000 + "\n")


def test_a_stored_probe_stays_apart(spark, tmp_path):
    frame(spark, [(-1, 0, "user", "mine", ""), (3, 0, "assistant", "a", ""), (None, 0, "assistant", "b", "")]).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((str(r.conv_id), r.n_turns, r.loss_chars) for r in K.op4(spark, str(tmp_path)).collect())
    assert got == [("-1", 1, 0), ("-1", 2, len(K.PROBE)), ("3", 1, 1), ("None", 1, 1)]
