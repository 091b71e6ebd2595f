"""Composite patterns: evidence as column expressions, scores as column expressions, episodes by a deterministic state machine.

A detector is a function of its sign that returns named evidence and the inputs of the machine. The machine needs only past
state, so it is one grouped map over (series, pattern) on a narrow projection; its streaming twin is in streaming.machine.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.functions.scalars import any_true
from barograph.operators.structure import dealt
from barograph.operators.windows import KEYS, lag, last
from barograph.plans.evidence import INDICATORS, events_by_bar, pivots_by_bar
from barograph.sources.scratch import stash
from barograph.plans.machine import HOOKS, MACHINES, STATES, run_machine

C = F.col
COMPONENTS = {"structure": 0.30, "momentum": 0.25, "volatility": 0.20, "regime": 0.15, "context": 0.10}
TREND = {1: "uptrend", -1: "downtrend"}
#: Evidence that does not weigh 1. Fixed values.
WEIGHTS = {
    ("exhaustion", "exhaustion_gap"): 0.25, ("exhaustion", "hurst_persistent"): 0.5, ("exhaustion", "structure_exhaustion_flag"): 0.5, ("breakout", "breakout_gap"): 0.25,
    ("breakout", "level_known_before_event"): 0.5, ("mean_reversion", "hurst_antipersistent"): 0.5, ("mean_reversion", "entropy_high"): 0.5, ("mean_reversion", "trend_persistent_structure"): 1.5,
    ("divergence", "any_indicator_divergence"): 0.5,
}
PERSISTENT_CAP = 0.4


def false() -> Column:
    return F.lit(False)




@dataclass
class Detector:
    """Evidence (name, component, condition) and the machine's inputs; unset inputs take the defaults of HOOKS."""

    required: list[str]
    support: list[tuple[str, str, Column]]
    against: list[tuple[str, str, Column]]
    hooks: dict[str, Column] = field(default_factory=dict)
    cap: Column | None = None
    memory: Column | None = None


def is_state(column: str, value: str) -> Column:
    return F.coalesce(C(column) == value, false())


def higher_is(value: str) -> Column:
    return C("htf_structural_state") == value


def near_opposing(move: int) -> Column:
    return C("resistance_dist_atr" if move > 0 else "support_dist_atr") <= 1.0


def expanding() -> Column:
    return any_true(C("volatility_expansion"), C("atr_expansion") >= 1.25)


def regime_shift() -> Column:
    return F.greatest(F.abs(C("hmm_p_high") - C("hmm_p_high_lag")), F.abs(C("markov_p_high") - C("markov_p_high_lag")))


def regime_stable_low() -> Column:
    some = C("hmm_p_high").isNotNull() | C("markov_p_high").isNotNull()
    low = F.coalesce(C("hmm_p_high") < 0.5, F.lit(True)) & F.coalesce(C("markov_p_high") < 0.5, F.lit(True))
    return F.when(some, low & F.coalesce(regime_shift() < 0.2, F.lit(True)))


def high_vol_rising() -> Column:
    return F.greatest(C("hmm_p_high") - C("hmm_p_high_lag"), C("markov_p_high") - C("markov_p_high_lag")) >= 0.2


def breakout_with(move: int) -> Column:
    return F.coalesce(C("breakout_state").isin("breakout_candidate", "breakout_confirmed") & (C("breakout_direction") == ("up" if move > 0 else "down")), false())


def accelerated(move: int) -> Column:
    return C("accel_up_recent" if move > 0 else "accel_down_recent")


def gap_with(move: int) -> Column:
    return C("gap_up_recent" if move > 0 else "gap_down_recent")


def exhaustion(sign: int) -> Detector:
    m = -sign
    z, slow, rs = C("zscore_20") * m, C("slope_change") * m < 0, C("relative_return_20") * m
    strong = F.when(C("relative_return_20").isNotNull() & C("ratio_slope").isNotNull(), (rs > 0) & (C("ratio_slope") * m > 0))
    support = [
        ("extended_vs_mean", "momentum", z >= 1.5), ("prior_acceleration", "momentum", accelerated(m)), ("deceleration", "momentum", slow),
        ("slope_deteriorating", "momentum", (C("rolling_slope_20") - C("_slope_3")) * m < 0),
        ("rs_weakening", "momentum", any_true(C("relative_return_5") * m < 0, C("ratio_slope") * m < 0)),
        ("structure_exhaustion_flag", "structure", C("exhaustion_candidate")), ("near_opposing_level", "structure", near_opposing(m)), ("volatility_expanding", "volatility", expanding()),
        ("relative_volume_high", "volatility", C("relative_volume") >= 1.5), ("garch_vol_rising", "volatility", C("garch_vol_ratio") >= 1.2),
        ("change_point_recent", "regime", any_true(C("cp_rv20_recent"), C("cp_slope_recent"))), ("high_vol_regime_rising", "regime", high_vol_rising()),
        ("vix_extreme", "context", C("vix_zscore") <= -1.0 if m > 0 else C("vix_zscore") >= 1.0), ("breadth_diverging", "context", C("breadth_sma50_change5") * m < 0),
        ("exhaustion_gap", "structure", gap_with(m)),
    ]
    against = [
        ("higher_tf_trend_intact", "structure", higher_is(TREND[m])), ("rs_still_strong", "momentum", strong), ("active_breakout_with_move", "structure", breakout_with(m)),
        ("low_vol_regime_stable", "regime", regime_stable_low()), ("hurst_persistent", "regime", C("hurst") > 0.55),
    ]
    hooks = {
        "keep": F.coalesce(z > 0, false()), "keep_scored": F.lit(True), "mem_a": C("_high_5") if m > 0 else C("_low_5"), "confirm_now": F.coalesce(z <= 0, false()),
        "fail_sign": F.lit(m), "fail_margin": 0.5 * C("atr"),
    }
    return Detector(["extended_vs_mean", "prior_acceleration", "deceleration"], support, against, hooks, memory=F.struct(hooks["mem_a"].alias("move_extreme")))


def breakout(sign: int) -> Detector:
    d, side = sign, "up" if sign > 0 else "down"
    e = C(f"_cand_{side}")
    there = e.isNotNull()
    known = e["level_asof_index"] < e["bar_index"]
    rv, vix, b = C("relative_volume"), C("vix_zscore"), C("breadth_sma50")
    support = [
        ("causal_breakout_event", "structure", there), ("level_known_before_event", "structure", known), ("strong_level", "structure", F.when(there, F.coalesce(e["level_touch_count"], F.lit(0)) >= 3)),
        ("prior_compression", "volatility", C("compression_recent")), ("structure_aligned", "structure", is_state("structural_state", TREND[d])), ("higher_tf_aligned", "structure", higher_is(TREND[d])),
        ("volatility_expansion", "volatility", expanding()), ("relative_volume_ok", "momentum", rv >= 1.0), ("rs_aligned", "momentum", C("relative_return_20") * d > 0),
        ("slope_aligned", "momentum", C("rolling_slope_20") * d > 0), ("regime_stable", "regime", regime_stable_low()), ("vix_supportive", "context", vix < 1.0 if d > 0 else vix > 0),
        ("breadth_supportive", "context", b >= 0.5 if d > 0 else b < 0.5), ("breakout_gap", "structure", gap_with(d)),
    ]
    slow, weak = C("slope_change") * d < 0, C("relative_return_20") * d < 0
    against = [
        ("low_volume", "momentum", rv < 1.0), ("rs_against", "momentum", weak), ("momentum_decelerating", "momentum", slow),
        ("close_near_level", "structure", F.abs(C("close") - e["level"]) < 0.25 * C("atr")), ("higher_tf_against", "structure", higher_is(TREND[-d])),
        ("vix_spike", "context", vix >= 2.0 if d > 0 else F.when(vix.isNotNull(), false())),
    ]
    here = lambda state: F.transform(F.filter(F.coalesce("events_here", F.array().cast("array<struct<state:string,direction:string,level:double,level_asof_index:int>>")), lambda x: (x["state"] == state) & (x["direction"] == side)), lambda x: F.struct(x["level"].alias("level"), x["level_asof_index"].alias("asof")))
    hooks = {
        "fresh": F.coalesce(e["bar_index"] == C("bar_index"), false()), "mem_a": e["level"], "mem_asof": e["level_asof_index"], "confirm_events": here("breakout_confirmed"), "fail_events": here(f"fake_breakout_{side}"),
        "fail_sign": F.lit(-d), "fail_margin": F.lit(0.0), "fail_inclusive": F.lit(True), "near": 0.25 * C("atr"), "risky": F.coalesce(slow & weak, false()),
        "expansive": F.coalesce(expanding() & (rv >= 1.0), false()), "kind": F.lit("breakout"),
    }
    memory = F.struct(e["level"].alias("level"), e["level_asof_index"].alias("level_asof_index"), e["timestamp"].alias("breakout_timestamp"), e["distance_atr"].alias("breakout_distance_atr"), e["relative_volume"].alias("relative_volume"), e["level_type"].alias("level_type"), e["level_touch_count"].alias("level_touch_count"))
    return Detector(["causal_breakout_event", "level_known_before_event"], support, against, hooks, memory=memory)


def failed_breakout(sign: int) -> Detector:
    b, side = -sign, "down" if sign > 0 else "up"
    e = C(f"_fake_{side}")
    there = e.isNotNull()
    support = [
        ("causal_fake_breakout_event", "structure", there), ("back_in_range", "structure", (e["level"] - C("close")) * b >= 0.25 * C("atr")),
        ("strong_level", "structure", F.when(there, F.coalesce(e["level_touch_count"], F.lit(0)) >= 3)), ("momentum_deteriorating", "momentum", C("slope_change") * b < 0),
        ("rs_weak", "momentum", C("relative_return_5") * b < 0), ("volume_on_failure", "momentum", C("relative_volume") >= 1.0), ("volatility_expansion", "volatility", expanding()),
        ("high_vol_regime_rising", "regime", high_vol_rising()), ("vix_rising", "context", C("vix_change_5d") * b > 0),
    ]
    against = [("close_reclaims_level", "structure", (C("close") - e["level"]) * b > 0), ("rs_strong", "momentum", C("relative_return_20") * b > 0), ("higher_tf_aligned_with_breakout", "structure", higher_is(TREND[b]))]
    hooks = {
        "fresh": F.coalesce(e["bar_index"] == C("bar_index"), false()), "mem_a": e["level"], "mem_asof": e["level_asof_index"], "confirm_sign": F.lit(-b), "confirm_need": F.lit(2),
        "fail_sign": F.lit(b), "fail_margin": 0.25 * C("atr"),
    }
    memory = F.struct(e["level"].alias("level"), e["level_asof_index"].alias("level_asof_index"), (e["bar_index"] - e["failure_bars"]).alias("breakout_index"), e["timestamp"].alias("failure_timestamp"), e["failure_bars"].alias("bars_to_failure"), e["distance_atr"].alias("breakout_distance_atr"), e["relative_volume"].alias("relative_volume"), F.when(F.coalesce(expanding(), false()), "expanding").otherwise("not_expanding").alias("volatility_context"))
    return Detector(["causal_fake_breakout_event"], support, against, hooks, memory=memory)


def mean_reversion(sign: int) -> Detector:
    m = -sign
    z, slow, near = C("zscore_20") * m, C("slope_change") * m < 0, near_opposing(m)
    tired = any_true(slow, C("exhaustion_candidate"), near)
    trend = is_state("structural_state", TREND[m])
    persists, kalman = C("hurst") > 0.55, C("kalman_level_change") * m > 0
    regime = F.when(persists.isNotNull() | kalman.isNotNull(), F.coalesce(persists, false()) | (F.coalesce(kalman, false()) & F.coalesce(accelerated(m), false())))
    blocked = trend & F.coalesce(regime, false())
    b, vix = C("breadth_sma50"), C("vix_zscore")
    support = [
        ("extreme_zscore", "momentum", z >= 2.0), ("exhaustion_evidence", "momentum", tired), ("near_opposing_level", "structure", near), ("deceleration", "momentum", slow),
        ("volatility_elevated", "volatility", C("rv20_percentile") >= 0.8), ("hurst_antipersistent", "regime", C("hurst") < 0.45), ("entropy_high", "regime", C("permutation_entropy") >= 0.95),
        ("breadth_extreme", "context", b <= 0.2 if m < 0 else b >= 0.8), ("vix_extreme", "context", vix >= 1.5 if m < 0 else vix <= -1.0),
    ]
    against = [
        ("trend_persistent_structure", "structure", trend), ("regime_persistent", "regime", regime), ("higher_tf_trend_aligned", "structure", higher_is(TREND[m])),
        ("still_accelerating", "momentum", is_state("acceleration_state", "accelerating_up" if m > 0 else "accelerating_down")),
    ]
    hooks = {
        "keep_required": F.lit(True), "keep_scored": F.lit(True), "mem_a": C("high") if m > 0 else C("low"), "mem_b": z, "confirm_now": F.coalesce(z <= 1.0, false()) & ~blocked,
        "fail_sign": F.lit(m), "fail_margin": C("atr"), "stretch": z,
    }
    return Detector(["extreme_zscore", "exhaustion_evidence"], support, against, hooks, cap=blocked, memory=F.struct(C("zscore_20").alias("z_start"), hooks["mem_a"].alias("move_extreme")))


def trend_continuation(sign: int) -> Detector:
    d = sign
    trigger, stop = (C("last_high"), C("last_low")) if d > 0 else (C("last_low"), C("last_high"))
    trend = is_state("structural_state", TREND[d])
    back = F.when(trigger.isNotNull() & stop.isNotNull() & C("zscore_20").isNotNull(), ((C("close") - trigger) * d < 0) & ((C("close") - stop) * d > 0) & (C("zscore_20") * d <= 0.5))
    wide, garch = expanding(), C("garch_vol_ratio")
    calm = F.when(wide.isNotNull() | garch.isNotNull(), ~(F.coalesce(wide, false()) | F.coalesce(garch > 1.2, false())))
    b, vix = C("breadth_sma50"), C("vix_zscore")
    support = [
        ("structure_trend", "structure", trend), ("slope_aligned", "momentum", C("rolling_slope_20") * d > 0), ("pullback", "structure", back),
        ("compression_recent", "volatility", any_true(C("compression_recent"), C("volatility_compression"))), ("higher_tf_aligned", "structure", higher_is(TREND[d])),
        ("kalman_aligned", "momentum", C("kalman_level_change") * d > 0), ("rs_aligned", "momentum", C("relative_return_20") * d > 0), ("volatility_compatible", "volatility", calm),
        ("regime_stable", "regime", regime_stable_low()), ("breadth_supportive", "context", b >= 0.6 if d > 0 else b <= 0.4), ("vix_supportive", "context", vix < 1.0 if d > 0 else vix > 1.0),
    ]
    label = C("last_high_label" if d > 0 else "last_low_label")
    against = [
        ("rs_against", "momentum", C("relative_return_20") * d < 0), ("volatility_expanding", "volatility", wide), ("regime_shifting", "regime", regime_shift() >= 1.5 * 0.2),
        ("higher_tf_against", "structure", higher_is(TREND[-d])), ("structure_warning", "structure", label == ("LH" if d > 0 else "HL")),
    ]
    hooks = {
        "keep": trend, "keep_scored": F.lit(True), "mem_a": stop, "mem_b": trigger, "confirm_sign": F.lit(d), "confirm_slot": F.lit("b"), "fail_sign": F.lit(-d), "fail_margin": F.lit(0.0),
        "fail_now": is_state("structural_state", TREND[-d]),
    }
    return Detector(["structure_trend", "slope_aligned", "pullback"], support, against, hooks, memory=F.struct(trigger.alias("trigger"), stop.alias("stop")))


def regime_transition(sign: int) -> Detector:
    into = lambda p: p if sign > 0 else 1 - p
    hmm, hmm_lag, mk, mk_lag = (into(C(c)) for c in ("hmm_p_high", "hmm_p_high_lag", "markov_p_high", "markov_p_high_lag"))
    crossed = any_true((hmm >= 0.5) & (hmm_lag < 0.5) & hmm_lag.isNotNull(), (mk >= 0.5) & (mk_lag < 0.5) & mk_lag.isNotNull())
    crossed = F.when((hmm + hmm_lag).isNotNull() | (mk + mk_lag).isNotNull(), F.coalesce(crossed, false()))
    two = hmm.isNotNull() & mk.isNotNull()
    moves = (C("realized_volatility_20") - C("_rv_5")) * sign > 0
    support = [
        ("validated_regime_models", "regime", hmm.isNotNull() | mk.isNotNull()), ("regime_probability_cross", "regime", crossed), ("other_model_agrees", "regime", F.when(two, (hmm >= 0.5) & (mk >= 0.5))),
        ("change_point_rv20", "regime", C("cp_rv20_recent")), ("change_point_slope", "regime", C("cp_slope_recent")), ("rv20_moving", "volatility", moves),
        ("garch_vol_moving", "volatility", C("garch_vol_ratio") >= 1.2 if sign > 0 else C("garch_vol_ratio") <= 0.8), ("structure_changed", "structure", C("structure_changed_recent")),
        ("kalman_turn", "momentum", (C("kalman_level_change") > 0) != (C("kalman_level_change_lag") > 0)), ("vix_moving", "context", C("vix_change_5d") * sign > 0),
    ]
    against = [("models_disagree", "regime", F.when(two, (F.least(hmm, mk) < 0.3) & (F.greatest(hmm, mk) >= 0.5))), ("rv20_against", "volatility", ~moves)]
    gone = F.greatest(hmm, mk) < 0.4  # greatest() skips nulls: all that are there
    hooks = {"confirm_now": F.coalesce(two & (F.least(hmm, mk) >= 0.6), false()), "confirm_need": F.lit(3), "fail_now": F.coalesce(gone, false()), "kind": F.lit("regime")}
    memory = F.struct(C("hmm_p_high").alias("hmm2_p_high"), C("hmm_p_high_lag").alias("hmm2_p_high_lag"), C("markov_p_high").alias("markov2_p_high"), C("markov_p_high_lag").alias("markov2_p_high_lag"))
    return Detector(["validated_regime_models", "regime_probability_cross"], support, against, hooks, memory=memory)


def divergence(sign: int) -> Detector:
    m = -sign
    p = C("_ph" if m > 0 else "_pl")
    label = C("last_high_label" if m > 0 else "last_low_label")
    extreme = F.coalesce((C("bar_index") - p["index"] <= 7) & (label == ("HH" if m > 0 else "LL")), false())
    parts = {name: F.when(extreme, (p["new"][column] - p["old"][column]) * m < 0) for name, (column, _) in INDICATORS.items()}
    any_part = F.when(extreme, any_true(*parts.values())).otherwise(false())
    support = [("price_new_extreme", "structure", extreme), ("any_indicator_divergence", "momentum", any_part), *((name, INDICATORS[name][1], value) for name, value in parts.items())]
    support += [("near_opposing_level", "structure", near_opposing(m)), ("deceleration", "momentum", C("slope_change") * m < 0), ("volatility_expanding", "volatility", expanding())]
    strong = is_state("structural_state", TREND[m]) & F.coalesce(higher_is(TREND[m]), false())
    against = [("structure_trend_strong", "structure", strong), ("active_breakout_with_move", "structure", breakout_with(m)), ("rs_strong", "momentum", C("relative_return_20") * m > 0)]
    hooks = {
        "fresh": F.coalesce(C("new_swing_high" if m > 0 else "new_swing_low"), false()), "mem_a": p["price"], "mem_b": p["neck"], "confirm_sign": F.lit(-m), "confirm_slot": F.lit("b"),
        "fail_sign": F.lit(m), "fail_margin": 0.25 * C("atr"),
    }
    memory = F.struct(p["price"].alias("pivot_price"), p["neck"].alias("neckline"), p["old_index"].alias("old_pivot_index"), p["index"].alias("pivot_index"))
    return Detector(["price_new_extreme", "any_indicator_divergence"], support, against, hooks, memory=memory)


FAMILIES = {
    "exhaustion": (exhaustion, ("bullish", "bearish")), "breakout": (breakout, ("bullish", "bearish")), "failed_breakout": (failed_breakout, ("bullish", "bearish")),
    "mean_reversion": (mean_reversion, ("bullish", "bearish")), "trend_continuation": (trend_continuation, ("bullish", "bearish")),
    "regime_transition": (regime_transition, ("to_high_vol", "to_low_vol")), "divergence": (divergence, ("bullish", "bearish")),
}


def names_where(items, test) -> Column:
    """Names of the evidence whose value passes a test."""
    return F.array_compact(F.array(*(F.when(test(value), F.lit(name)) for name, _, value in items)))


def component_score(family: str, component: str, support, against) -> Column:
    """Supporting weight present over supporting weight evaluable plus contradicting weight present; null if that is 0."""
    weight = lambda name: F.lit(WEIGHTS.get((family, name), 1.0))
    total = lambda items, test: reduce(lambda a, b: a + b, (F.when(test(v), weight(n)).otherwise(0.0) for n, c, v in items if c == component), F.lit(0.0))
    yes = lambda v: F.coalesce(v, false())
    return total(support, yes) / F.nullif(total(support, lambda v: v.isNotNull()) + total(against, yes), F.lit(0.0))


def pattern_score(scores: dict[str, Column]) -> Column:
    """Weighted mean over the components that have a score, rounded to 6; 0 if none has."""
    top = reduce(lambda a, b: a + b, (F.coalesce(s * COMPONENTS[c], F.lit(0.0)) for c, s in scores.items()))
    base = reduce(lambda a, b: a + b, (F.when(s.isNotNull(), COMPONENTS[c]).otherwise(0.0) for c, s in scores.items()))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(top / F.nullif(base, F.lit(0.0)), F.lit(0.0)))), 6)


def observe(frame: DataFrame, events: DataFrame, swings: DataFrame, families: dict = FAMILIES) -> DataFrame:
    """frame x patterns: scores, evidence lists and machine inputs of every detector and direction, from one pass over the frame."""
    x = pivots_by_bar(events_by_bar(frame, events), swings)
    x = stash(x.withColumns({"_slope_3": lag("rolling_slope_20", 3), "_rv_5": lag("realized_volatility_20", 5), "_high_5": F.max("high").over(last(5)), "_low_5": F.min("low").over(last(5))}), "observed")
    rows = []
    for family, (make, directions) in families.items():
        for direction in directions:
            d = make(1 if direction in ("bullish", "to_high_vol") else -1)
            scores = {c: component_score(family, c, d.support, d.against) for c in COMPONENTS}
            score = pattern_score(scores)
            cap = false() if d.cap is None else d.cap
            score = F.when(cap, F.least(score, F.lit(PERSISTENT_CAP))).otherwise(score)
            required = [s for s in d.support if s[0] in d.required]
            ok = reduce(lambda a, b: a & b, (F.coalesce(v, false()) for _, _, v in required))
            missing = F.array_sort(names_where(d.support + d.against, lambda v: v.isNull()))
            notes = F.array_compact(F.array(F.when(cap, F.lit("capped_trend_and_regime_persistent")), F.when(F.size(missing) > 0, F.concat(F.lit("not_evaluable:"), F.array_join(missing, ",")))))
            optional = [s for s in d.support if s[0] not in d.required]
            yes, no = (lambda v: F.coalesce(v, false())), (lambda v: ~F.coalesce(v, false()))
            rows.append(F.struct(
                F.lit(f"{direction}_{family}").alias("pattern_name"), F.lit(family).alias("pattern_family"), F.lit(direction).alias("direction"), score.alias("score"),
                *(F.round(s, 6).alias(f"score_{c}") for c, s in scores.items()), names_where(d.support, yes).alias("evidence_for"), names_where(d.against, yes).alias("evidence_against"),
                names_where(required, yes).alias("required_conditions_met"), names_where(required, no).alias("required_conditions_missing"), names_where(optional, yes).alias("optional_conditions_met"),
                notes.alias("notes"), ok.alias("required_ok"), F.to_json(d.memory).alias("memory_now"), F.struct(*(d.hooks.get(k, default()).cast(kind).alias(k) for k, (kind, default) in HOOKS.items())).alias("hooks"),
            ))
    return x.withColumn("p", F.explode(F.array(*rows))).select(*KEYS, "bar_index", "timestamp", "close", "p.*")


MACHINE_OUT = (
    "ticker string, timeframe string, pattern_name string, bar_index int, state string, episode_id int, bars_active int, first_detected_at timestamp, confirmed_at timestamp, "
    "invalidated_at timestamp, expired_at timestamp, subtype string, details string"
)


def track(observed: DataFrame) -> DataFrame:
    """Adds each bar's state and episode to observe()'s rows: one grouped map over (series, pattern) on the machine's inputs only."""
    inputs = observed.select(*KEYS, "pattern_name", "pattern_family", "bar_index", "timestamp", "close", "score", "required_ok", "memory_now", "hooks.*")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_index", kind="stable").reset_index(drop=True)
        rows = run_machine(pdf.to_dict("records"), MACHINES[pdf["pattern_family"].iloc[0]])
        return pd.DataFrame(rows).assign(ticker=pdf["ticker"], timeframe=pdf["timeframe"], pattern_name=pdf["pattern_name"], bar_index=pdf["bar_index"])[[c.split()[0] for c in MACHINE_OUT.split(", ")]]

    states = dealt(inputs, *KEYS, "pattern_name").groupBy(*KEYS, "pattern_name").applyInPandas(run, MACHINE_OUT)
    return observed.drop("hooks", "required_ok", "memory_now").join(states, [*KEYS, "pattern_name", "bar_index"])


__all__ = ["COMPONENTS", "FAMILIES", "STATES", "observe", "track"]
