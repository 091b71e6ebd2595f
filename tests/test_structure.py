import random

import pytest
from pyspark.sql import functions as F

from barograph.functions import scalars
from barograph.operators import context, features, joins, models, structure
from barograph.operators.estimators import change_points, fit_regimes, fit_state, fit_variance, hurst
from barograph.plans import engine
from barograph.plans.machine import HOOKS, MACHINES, Machine, run_machine

BARS = "ticker string, timeframe string, timestamp timestamp, bar_index int, open double, high double, low double, close double, volume double"


def frame(spark, closes, opens=None, volume=1000.0, ticker="A"):
    import datetime as dt

    rows = []
    for i, c in enumerate(closes):
        o = opens[i] if opens else (closes[i - 1] if i else c)
        rows.append((ticker, "1Day", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), i, float(o), max(o, c) + 0.2, min(o, c) - 0.2, float(c), volume))
    return spark.createDataFrame(rows, BARS)


def walk(n, seed=3):
    rng, c, out = random.Random(seed), 100.0, []
    for _ in range(n):
        c = round(c * (1 + rng.gauss(0, 0.012)), 2)
        out.append(c)
    return out


def test_swing_latency(spark):
    rows = structure.confirmed_swings(frame(spark, [10, 11, 14, 12, 10, 9, 12], [10, 11, 14, 12, 10, 9, 12]), 2, 2).where("type = 'swing_high'").collect()
    assert [(r.bar_index, r.confirmation_index) for r in rows] == [(2, 4)]


def test_breakout_confirmed_and_fake(spark):
    for tail, state in (([102, 103, 104], "breakout_confirmed"), ([102, 100, 99], "fake_breakout_up")):
        bars = frame(spark, [100.0] * 25 + tail)
        bars = bars.withColumn("volume", F.when(F.col("bar_index") >= 25, 3000.0).otherwise(F.col("volume")))
        levels = bars.limit(1).select("ticker", "timeframe", F.lit(101.0).alias("price_level"), F.lit("2023-12-01").cast("timestamp").alias("available_at"))
        got = structure.detect_breakouts_fixed_levels(bars, levels).collect()
        hit = [r for r in got if r.state == state]
        assert hit and (state == "breakout_confirmed" or (hit[0].bar_index, hit[0].failure_bars) == (26, 1))


def test_gap_and_fill(spark):
    got = structure.detect_gaps(frame(spark, [100, 104, 103, 100], [100, 105, 103, 100]), min_gap=0.02).where("type = 'gap_up'").orderBy("bar_index").collect()
    assert [(r.bar_index, r.type, r.state, r.time_to_fill_bars) for r in got] == [(1, "gap_up", "unfilled_gap", None), (3, "gap_up", "gap_fill", 2)]


def test_levels_do_not_look_ahead(spark):
    bars = frame(spark, walk(300), walk(300))
    swings = structure.confirmed_swings(bars)
    full = {(r.asof_index, r.price_level, r.touch_count) for r in structure.levels_history(bars, swings).collect()}
    short = bars.where("bar_index <= 220")
    part = {(r.asof_index, r.price_level, r.touch_count) for r in structure.levels_history(short, structure.confirmed_swings(short)).collect()}
    assert part == {x for x in full if x[0] <= 220} and part


@pytest.mark.parametrize("run", [
    lambda b: features.compression_features(features.acceleration_features(features.statistical_features(b))).select("bar_index", "zscore_20", "rolling_slope_20", "acceleration_state", "compression_duration"),
    lambda b: structure.structure_asof(b, structure.confirmed_swings(b)).select("bar_index", "structural_state", "last_high", "prev_low"),
])
def test_prefix_invariance(spark, run):
    assert engine.prefix_differences(run, frame(spark, walk(140), walk(140)), 100).isEmpty()


def machine_rows(n, required=lambda i: True, confirm=lambda i: False, fail=lambda i: False):
    base = {k: None for k in HOOKS} | {"fresh": True, "keep": True, "keep_required": True, "keep_scored": False, "fail_inclusive": False, "confirm_need": 1, "confirm_slot": "a", "kind": "", "risky": False, "expansive": False}
    return [base | {"timestamp": i, "close": 1.0, "score": 0.9, "required_ok": required(i), "memory_now": None, "confirm_now": confirm(i), "fail_now": fail(i)} for i in range(n)]


def test_machine_lifecycle():
    states = lambda rows, m: [r["state"] for r in run_machine(rows, m)]
    got = states(machine_rows(13, lambda i: 2 <= i <= 19, lambda i: i == 6), Machine(time_to_live=3, cooldown=2))
    assert got == ["inactive"] * 2 + ["candidate"] * 2 + ["developing"] * 2 + ["confirmed"] * 4 + ["inactive"] * 2 + ["candidate"]
    assert states(machine_rows(8, lambda i: 2 <= i <= 3), Machine())[6] == "expired"
    got = run_machine(machine_rows(10, lambda i: i >= 2), Machine(max_pending=6))
    assert (got[8]["state"], got[8]["bars_active"]) == ("expired", 7)
    got = run_machine(machine_rows(8, lambda i: i >= 1, lambda i: i == 4, lambda i: i == 6), Machine())
    assert got[6]["state"] == "invalidated" and got[6]["confirmed_at"] == 4
    assert set(MACHINES) == {"exhaustion", "breakout", "failed_breakout", "mean_reversion", "trend_continuation", "regime_transition", "divergence"}


def test_asof_join_takes_the_last_known(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 10), (3, "b", 10), (4, "a", 1)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 9, "y"), ("b", 11, "z")], "k string, s int, v string")
    got = {r.id: r.v for r in joins.asof_join(left, right, "t", "s", by=["k"], columns=["v"]).collect()}
    assert got == {1: "x", 2: "y", 3: None, 4: None}


def test_macro_states_equal_the_history(spark):
    rows, rng = [], random.Random(1)
    for d in range(1, 60):
        day = f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}"
        for s in ("fed_assets", "tga", "rrp"):
            if s != "fed_assets" or d % 7 == 3:
                rows += [(s, day, f"2024-{1 + (d + w) // 28:02d}-{1 + (d + w) % 28:02d}", float(rng.randint(1, 90)), True) for w in (2, 9)]
    m = spark.createDataFrame(rows, "series string, o string, a string, value double, asof_safe boolean").select("series", F.col("o").cast("timestamp").alias("observation_date"), F.col("a").cast("timestamp").alias("available_at"), "value", "asof_safe")
    states = {r.known_at: r for r in context.macro_states(m).collect()}
    for known in sorted(states)[10::12]:
        last = context.macro_liquidity_history(m.where(F.col("available_at") <= F.lit(known))).orderBy(F.desc("observation_date")).first()
        assert states[known].macro_liquidity_state == (last.liquidity_state if last else None)


def test_scalars(spark):
    x = spark.createDataFrame([(None, False), (None, None), (True, None), (False, False)], "a boolean, b boolean")
    assert [r[0] for r in x.select(scalars.any_true(F.col("a"), F.col("b"))).collect()] == [False, None, True, False]
    t = spark.createDataFrame([("u?series_id=WALCL&api_key=abc123&file_type=json",)], "t string")
    assert t.select(scalars.redact_secrets(F.col("t"))).first()[0] == "u?series_id=WALCL&api_key=[REDACTED]&file_type=json"


def test_estimators():
    import numpy as np

    rng = np.random.default_rng(0)
    y = np.concatenate([rng.normal(0, 1, 60), rng.normal(4, 1, 60)])
    assert change_points(y, 3.0, 10) == [59]
    x = np.concatenate([rng.normal(0, 0.5, 150), rng.normal(0, 3, 150)]).reshape(-1, 1)
    fit = fit_regimes(x, 2)
    assert all(b >= a - 1e-6 for a, b in zip(fit["history"], fit["history"][1:]))
    assert np.allclose(fit["transition"].sum(axis=1), 1)
    assert fit_variance("garch", rng.normal(0, 1, 300))["params"][1] < 0.3
    assert fit_state(np.cumsum(rng.normal(0, 1, 200)))["params"][1] > 0.3
    assert 0.3 < hurst(rng.normal(0, 1, 1000)) < 0.75


def test_registry(spark):
    names = lambda df: {r.name for r in df.collect()}
    assert names(models.validated_models(spark, "level")) == {"kalman_local_level"}
    assert names(models.validated_models(spark, "slope_description")) == set()
    assert names(models.allowed_models(spark, "slope_description")) == {"kalman_local_linear_trend"}
