"""DuckDB SQL for the evidence frame, the pattern detectors, the state machine and the reports on them, from the definitions.

The evidence is one join of independent pieces by (ticker, bar); conditions are written per side `m` (1 or -1); the machine is
a recursive query that advances all (series, pattern) pairs by one bar a step. Without models the models' evidence is null.
"""

from __future__ import annotations

from barograph.plans.oracle import ACC, ALL_LEVELS, ASOF, BARS, CLOSE, COMP, GAPS, HAR, LAG, MEAN, OUTSIDE, STD, TO_UTC, WEEKLY, full, prior, scan

BY = "over (partition by ticker order by i)"
SLOPE = full("regr_slope(c, i::double)", "c", 20)
WEEK_BARS = WEEKLY.replace("\nbars as (", "\ndays as (").replace("from bars", "from days") + ",\nbars as (select ticker, row_number() over (partition by ticker order by ts) - 1 as i, o, h, l, c, v, ts, closed from wk where complete)\n"
RECENT = lambda cond, k: f"coalesce(max(({cond})::int) over (partition by ticker order by i rows between {k - 1} preceding and current row), 0) = 1"

PIECES = {
    "e_ret": f"with {HAR} select ticker, i, rv as rv20, {SLOPE} as sl, (c - {MEAN}) / nullif({STD}, 0) as z, c / {LAG('c', 20)} - 1 as mom20 from rv",
    "e_pct": f"with {HAR} select a.ticker, a.i, case when any_value(a.rv) is not null and count(b.rv) >= 60 then count(*) filter (b.rv < a.rv and b.i < a.i) / least(a.i, 251)::double end as rvp from har a left join har b on b.ticker = a.ticker and b.i between a.i - 251 and a.i group by a.ticker, a.i",
    "e_acc": f"with {ACC} select ticker, i, sc, state as acc_state, exhausted, rv as rvol, ax, {RECENT('slope > 0 and sc > 0', 10)} as acc_up, {RECENT('slope < 0 and sc < 0', 10)} as acc_dn from acc",
    "e_comp": f"with {COMP} select ticker, i, vc, ve, dur, coalesce(max(vc::int) {prior(20).replace('(w rows', 'over (partition by ticker order by i rows')}, 0) = 1 as squeezed from comp",
    "e_rs": f"with {BARS}, j as (select b.*, a.c as bc, b.c / a.c as q from bars b left join (select session_date, c from bars where ticker = 'AMERICA') a using (session_date)) select ticker, i, (c / {LAG('c', 5)} - 1) - (bc / {LAG('bc', 5)} - 1) as rr5, (c / {LAG('c', 20)} - 1) - (bc / {LAG('bc', 20)} - 1) as rr20, q, (ln(q) - ln({LAG('q', 20)})) / 20 as rslope, (q - {full('avg(q)', 'q', 20)}) / nullif({full('stddev_samp(q)', 'q', 20)}, 0) as rz from j",
    "e_near": f"with recursive {ALL_LEVELS}, n as (select ticker, aidx, max(price) filter (type in ('support', 'mixed') and price < c) as s, min(price) filter (type in ('resistance', 'mixed') and price > c) as r from levels group by all) select b.ticker, b.i, b.c, b.h, b.l, b.ts, b.atr, s as sup, r as res, (b.c - s) / case when b.atr > 0 then b.atr end as sd, (r - b.c) / case when b.atr > 0 then b.atr end as rd from lt b left join n on n.ticker = b.ticker and n.aidx = b.i",
    "e_gap": f"with {GAPS}, k as (select ticker, gap, type from gaps where state = 'unfilled_gap' and size_pct >= 0.005 and size_atr >= 0.5) select b.ticker, b.i, exists (select 1 from k where k.ticker = b.ticker and type = 'gap_up' and gap between b.i - 2 and b.i) as gap_up, exists (select 1 from k where k.ticker = b.ticker and type = 'gap_down' and gap between b.i - 2 and b.i) as gap_dn from bars b",
    "e_state": f"with {ASOF} select ticker, i, state, last_high, last_low, hl, ll, nh, nl, state <> {LAG('state', 10)} as changed from states",
    "e_out": f"with {OUTSIDE} select * from outside",
    "e_week": f"with {ASOF.replace(BARS, WEEK_BARS)} select s.ticker, b.closed, s.state from states s join bars b using (ticker, i)",
}
EVENTS = f"ev as materialized (with recursive {ALL_LEVELS}, lt0 as (select * from lt) {scan('select ticker, aidx + 1 as i, price as level, type as level_type, touches from levels')} select *, origin - 1 as ka from events)"
#: The frame `fr`, one row per bar, and `ev`, the breakout events.
FRAME = (
    ",\n".join([f"{name} as materialized ({sql})" for name, sql in PIECES.items()] + [EVENTS])
    + """,
recent as (select ticker, i, arg_max({'s': state, 'd': d, 'i': i}, (origin, level)) filter (state not like 'fake%') as b, arg_max({'s': state, 'd': d, 'i': i}, (origin, level)) filter (state like 'fake%') as f from ev group by all),
f0 as (select n.*, t.* exclude (ticker, i), p.rvp, a.* exclude (ticker, i), k.* exclude (ticker, i), r.* exclude (ticker, i), g.* exclude (ticker, i), s.* exclude (ticker, i), o.* exclude (ticker, i),
  last_value(x.b ignore nulls) over w as eb, last_value(x.f ignore nulls) over w as ef
  from e_near n join e_ret t using (ticker, i) join e_pct p using (ticker, i) join e_acc a using (ticker, i) join e_comp k using (ticker, i) join e_rs r using (ticker, i) join e_gap g using (ticker, i) join e_state s using (ticker, i)
  join e_out o using (ticker, i) left join recent x using (ticker, i) window w as (partition by n.ticker order by n.i rows between 5 preceding and current row)),
fr as materialized (select f0.*, coalesce(eb.s, 'inactive') as bo, case when eb.d = 1 then 'up' when eb.d = -1 then 'down' end as bod, coalesce(ef.s, 'inactive') as fbo, k.state as htf, sl / c as slp from f0 asof left join e_week k on k.ticker = f0.ticker and f0.ct >= k.closed)
"""
)
_row = "{'level': level, 'ka': ka, 'touches': touches, 'kind': level_type, 'dist': dist, 'rv': rv, 'fb': fb, 'i': i}"
_pick = lambda state, d: f"arg_min({_row}, (-coalesce(touches, 0), dist, level)) filter (state = '{state}' and d = {d})"
_list = lambda state, d: f"coalesce(list({{'l': level, 'a': ka}}) filter (state = '{state}' and d = {d}), [])"
INDICATORS = {"momentum_divergence": ("mom20", "momentum"), "slope_divergence": ("slp", "momentum"), "rs_divergence": ("q", "momentum"), "volume_divergence": ("rvol", "momentum"), "breadth_divergence": ("b50", "context")}
_pivot = lambda kind: f"arg_max({{'i': i, 'oi': oi, 'price': price, 'neck': neck, {', '.join(f'{c}: {c}, o{c}: o{c}'.replace(f'{c}:', repr(c) + ':', 1).replace(f' o{c}:', ' ' + repr('o' + c) + ':') for c, _ in INDICATORS.values())}}}, i) filter (type = '{kind}')"
#: `ob`: the frame with the events and the pivots that a bar can look back on.
OBSERVED = f"""
marks as (select ticker, i, {_pick('breakout_candidate', 1)} as cu, {_pick('breakout_candidate', -1)} as cd, {_pick('fake_breakout_up', 1)} as fu, {_pick('fake_breakout_down', -1)} as fd,
  {_list('breakout_confirmed', 1)} as okup, {_list('breakout_confirmed', -1)} as okdn, {_list('fake_breakout_up', 1)} as noup, {_list('fake_breakout_down', -1)} as nodn from ev group by ticker, i),
sw as (with {ASOF} select ticker, type, i, ci, price, lag(i) over (partition by ticker, type order by ci, i) as oi from swings),
pv as (select s.*, {', '.join(f'a.{c}, b.{c} as o{c}' for c, _ in INDICATORS.values())}, (select case when s.type = 'swing_high' then min(l) else max(h) end from fr n where n.ticker = s.ticker and n.i between least(s.i, s.oi) and greatest(s.i, s.oi)) as neck
  from sw s join fr a on a.ticker = s.ticker and a.i = s.i left join fr b on b.ticker = s.ticker and b.i = s.oi),
pm as (select ticker, ci as i, {_pivot('swing_high')} as ph, {_pivot('swing_low')} as pl from pv group by ticker, ci),
ob as materialized (select fr.*, lag(sl, 3) {BY} as sl3, lag(rv20, 5) {BY} as rv5, max(h) over (partition by fr.ticker order by fr.i rows between 4 preceding and current row) as h5, min(l) over (partition by fr.ticker order by fr.i rows between 4 preceding and current row) as l5,
  last_value(m.cu ignore nulls) over r as cu, last_value(m.cd ignore nulls) over r as cd, last_value(m.fu ignore nulls) over r as fu, last_value(m.fd ignore nulls) over r as fd, coalesce(m.okup, []) as okup, coalesce(m.okdn, []) as okdn, coalesce(m.noup, []) as noup, coalesce(m.nodn, []) as nodn,
  last_value(p.ph ignore nulls) over a as ph, last_value(p.pl ignore nulls) over a as pl
  from fr left join marks m using (ticker, i) left join pm p using (ticker, i) window r as (partition by fr.ticker order by fr.i rows between 5 preceding and current row), a as (partition by fr.ticker order by fr.i rows between unbounded preceding and current row))
""".replace("over (partition by ticker order by i)", "over (partition by fr.ticker order by fr.i)")


def any_true(*conds: str) -> str:
    """True if any is true, null if all are null, else false."""
    return f"case when {' or '.join(f'coalesce({c}, false)' for c in conds)} then true when {' and '.join(f'({c}) is null' for c in conds)} then null else false end"


WIDE = any_true("ve", "ax >= 1.25")
NONE = "null::boolean"
UP = {1: "uptrend", -1: "downtrend"}


def _sides(m: int) -> dict[str, str]:
    up = m > 0
    return {
        "near": f"{'rd' if up else 'sd'} <= 1.0", "acc": "acc_up" if up else "acc_dn", "gap": "gap_up" if up else "gap_dn", "slow": f"sc * {m} < 0", "htf": f"htf = '{UP[m]}'", "htf_against": f"htf = '{UP[-m]}'",
        "trend": f"coalesce(state = '{UP[m]}', false)", "active": f"coalesce(bo in ('breakout_candidate', 'breakout_confirmed') and bod = '{'up' if up else 'down'}', false)", "label": "hl" if up else "ll",
    }


#: Machine settings: enter, maintain and confirm scores, bars before developing, grace, longest pending, time to live.
SETTINGS = {
    "exhaustion": (0.40, 0.25, 0.35, 2, 2, 10, 5), "breakout": (0.0, 0.25, 0.0, 1, 2, 3, 10), "failed_breakout": (0.0, 0.25, 0.0, 1, 2, 6, 10), "mean_reversion": (0.40, 0.25, 0.35, 2, 2, 10, 5),
    "trend_continuation": (0.40, 0.25, 0.35, 2, 2, 15, 5), "regime_transition": (0.0, 0.25, 0.0, 1, 2, 10, 5), "divergence": (0.0, 0.25, 0.0, 2, 2, 15, 5),
}
COOLDOWN = 3
#: Inputs of the machine and what they are where a detector leaves them open.
INPUTS = {
    "fresh": "true", "keep": "true", "keep_required": "false", "keep_scored": "false", "mem_a": "null::double", "mem_b": "null::double", "mem_asof": "null::bigint", "now": "false", "csign": "null::int", "slot_b": "false", "need": "1",
    "has_ce": "false", "ce": "[]::struct(l double, a bigint)[]", "fail_now": "false", "fsign": "null::int", "fmargin": "null::double", "finc": "false", "fe": "[]::struct(l double, a bigint)[]", "stretch": "null::double", "nearby": "null::double",
    "risky": "false", "expansive": "false",
}
DETAILS = ["move_extreme", "level", "level_asof_index", "breakout_distance_atr", "relative_volume", "level_type", "level_touch_count", "breakout_index", "bars_to_failure", "volatility_context", "z_start", "trigger", "stop", "pivot_price", "neckline", "old_pivot_index", "pivot_index"]
TEXT_DETAILS = ("level_type", "volatility_context")


def detectors() -> list[dict]:
    """Each pattern: evidence (name, component, condition, weight) for and against, what is required, machine inputs, details."""
    out = []

    def add(family, direction, required, support, against, inputs, details, cap="false"):
        out.append({"family": family, "direction": direction, "required": required, "for": support, "against": against, "inputs": INPUTS | inputs, "details": details, "cap": cap})

    for sign, direction in ((1, "bullish"), (-1, "bearish")):
        m = -sign  # the move that tires
        s = _sides(m)
        z = f"(z * {m})"
        extreme = "h5" if m > 0 else "l5"
        add(
            "exhaustion", direction, ["extended_vs_mean", "prior_acceleration", "deceleration"],
            [("extended_vs_mean", "momentum", f"{z} >= 1.5"), ("prior_acceleration", "momentum", s["acc"]), ("deceleration", "momentum", s["slow"]), ("slope_deteriorating", "momentum", f"(sl - sl3) * {m} < 0"),
             ("rs_weakening", "momentum", any_true(f"rr5 * {m} < 0", f"rslope * {m} < 0")), ("structure_exhaustion_flag", "structure", "exhausted", 0.5), ("near_opposing_level", "structure", s["near"]),
             ("volatility_expanding", "volatility", WIDE), ("relative_volume_high", "volatility", "rvol >= 1.5"), ("garch_vol_rising", "volatility", NONE), ("change_point_recent", "regime", NONE),
             ("high_vol_regime_rising", "regime", NONE), ("vix_extreme", "context", "vix_zscore <= -1.0" if m > 0 else "vix_zscore >= 1.0"), ("breadth_diverging", "context", f"b50c * {m} < 0"), ("exhaustion_gap", "structure", s["gap"], 0.25)],
            [("higher_tf_trend_intact", "structure", s["htf"]), ("rs_still_strong", "momentum", f"case when rr20 is not null and rslope is not null then rr20 * {m} > 0 and rslope * {m} > 0 end"),
             ("active_breakout_with_move", "structure", s["active"]), ("low_vol_regime_stable", "regime", NONE), ("hurst_persistent", "regime", NONE, 0.5)],
            {"keep": f"coalesce({z} > 0, false)", "keep_scored": "true", "mem_a": extreme, "now": f"coalesce({z} <= 0, false)", "fsign": str(m), "fmargin": "0.5 * atr"}, {"move_extreme": extreme},
        )
        add(
            "mean_reversion", direction, ["extreme_zscore", "exhaustion_evidence"],
            [("extreme_zscore", "momentum", f"{z} >= 2.0"), ("exhaustion_evidence", "momentum", any_true(s["slow"], "exhausted", s["near"])), ("near_opposing_level", "structure", s["near"]), ("deceleration", "momentum", s["slow"]),
             ("volatility_elevated", "volatility", "rvp >= 0.8"), ("hurst_antipersistent", "regime", NONE, 0.5), ("entropy_high", "regime", NONE, 0.5), ("breadth_extreme", "context", "b50 <= 0.2" if m < 0 else "b50 >= 0.8"),
             ("vix_extreme", "context", "vix_zscore >= 1.5" if m < 0 else "vix_zscore <= -1.0")],
            [("trend_persistent_structure", "structure", s["trend"], 1.5), ("regime_persistent", "regime", NONE), ("higher_tf_trend_aligned", "structure", s["htf"]),
             ("still_accelerating", "momentum", f"acc_state = '{'accelerating_up' if m > 0 else 'accelerating_down'}'")],
            {"keep_required": "true", "keep_scored": "true", "mem_a": "h" if m > 0 else "l", "mem_b": z, "now": f"coalesce({z} <= 1.0, false)", "fsign": str(m), "fmargin": "atr", "stretch": z}, {"z_start": "z", "move_extreme": "h" if m > 0 else "l"},
        )
        p, is_new = ("ph", "nh") if m > 0 else ("pl", "nl")
        top = f"coalesce(i - {p}.i <= 7 and {s['label']} = '{'HH' if m > 0 else 'LL'}', false)"
        parts = {name: f"case when {top} then ({p}.{c} - {p}.o{c}) * {m} < 0 end" for name, (c, _) in INDICATORS.items()}
        add(
            "divergence", direction, ["price_new_extreme", "any_indicator_divergence"],
            [("price_new_extreme", "structure", top), ("any_indicator_divergence", "momentum", f"case when {top} then {any_true(*parts.values())} else false end", 0.5), *((n, INDICATORS[n][1], v) for n, v in parts.items()),
             ("near_opposing_level", "structure", s["near"]), ("deceleration", "momentum", s["slow"]), ("volatility_expanding", "volatility", WIDE)],
            [("structure_trend_strong", "structure", f"{s['trend']} and coalesce({s['htf']}, false)"), ("active_breakout_with_move", "structure", s["active"]), ("rs_strong", "momentum", f"rr20 * {m} > 0")],
            {"fresh": f"coalesce({is_new}, false)", "mem_a": f"{p}.price", "mem_b": f"{p}.neck", "csign": str(-m), "slot_b": "true", "fsign": str(m), "fmargin": "0.25 * atr"},
            {"pivot_price": f"{p}.price", "neckline": f"{p}.neck", "old_pivot_index": f"{p}.oi", "pivot_index": f"{p}.i"},
        )
        b = -sign  # the side whose break failed
        s, e = _sides(b), "fu" if b > 0 else "fd"
        add(
            "failed_breakout", direction, ["causal_fake_breakout_event"],
            [("causal_fake_breakout_event", "structure", f"{e} is not null"), ("back_in_range", "structure", f"({e}.level - c) * {b} >= 0.25 * atr"), ("strong_level", "structure", f"case when {e} is not null then coalesce({e}.touches, 0) >= 3 end"),
             ("momentum_deteriorating", "momentum", s["slow"]), ("rs_weak", "momentum", f"rr5 * {b} < 0"), ("volume_on_failure", "momentum", "rvol >= 1.0"), ("volatility_expansion", "volatility", WIDE), ("high_vol_regime_rising", "regime", NONE),
             ("vix_rising", "context", f"vix_change_5d * {b} > 0")],
            [("close_reclaims_level", "structure", f"(c - {e}.level) * {b} > 0"), ("rs_strong", "momentum", f"rr20 * {b} > 0"), ("higher_tf_aligned_with_breakout", "structure", s["htf"])],
            {"fresh": f"coalesce({e}.i = i, false)", "mem_a": f"{e}.level", "mem_asof": f"{e}.ka", "csign": str(-b), "need": "2", "fsign": str(b), "fmargin": "0.25 * atr"},
            {"level": f"{e}.level", "level_asof_index": f"{e}.ka", "breakout_index": f"{e}.i - {e}.fb", "bars_to_failure": f"{e}.fb", "breakout_distance_atr": f"{e}.dist", "relative_volume": f"{e}.rv", "volatility_context": f"case when coalesce({WIDE}, false) then 'expanding' else 'not_expanding' end"},
        )
        d = sign
        s, e, ok, no = (_sides(d), *(("cu", "okup", "noup") if d > 0 else ("cd", "okdn", "nodn")))
        weak = f"rr20 * {d} < 0"
        add(
            "breakout", direction, ["causal_breakout_event", "level_known_before_event"],
            [("causal_breakout_event", "structure", f"{e} is not null"), ("level_known_before_event", "structure", f"{e}.ka < {e}.i", 0.5), ("strong_level", "structure", f"case when {e} is not null then coalesce({e}.touches, 0) >= 3 end"),
             ("prior_compression", "volatility", "squeezed"), ("structure_aligned", "structure", s["trend"]), ("higher_tf_aligned", "structure", s["htf"]), ("volatility_expansion", "volatility", WIDE), ("relative_volume_ok", "momentum", "rvol >= 1.0"),
             ("rs_aligned", "momentum", f"rr20 * {d} > 0"), ("slope_aligned", "momentum", f"sl * {d} > 0"), ("regime_stable", "regime", NONE), ("vix_supportive", "context", "vix_zscore < 1.0" if d > 0 else "vix_zscore > 0"),
             ("breadth_supportive", "context", "b50 >= 0.5" if d > 0 else "b50 < 0.5"), ("breakout_gap", "structure", s["gap"], 0.25)],
            [("low_volume", "momentum", "rvol < 1.0"), ("rs_against", "momentum", weak), ("momentum_decelerating", "momentum", s["slow"]), ("close_near_level", "structure", f"abs(c - {e}.level) < 0.25 * atr"), ("higher_tf_against", "structure", s["htf_against"]),
             ("vix_spike", "context", "vix_zscore >= 2.0" if d > 0 else "case when vix_zscore is not null then false end")],
            {"fresh": f"coalesce({e}.i = i, false)", "mem_a": f"{e}.level", "mem_asof": f"{e}.ka", "has_ce": "true", "ce": ok, "fe": no, "fsign": str(-d), "fmargin": "0.0::double", "finc": "true", "nearby": "0.25 * atr",
             "risky": f"coalesce({s['slow']} and {weak}, false)", "expansive": f"coalesce(({WIDE}) and rvol >= 1.0, false)"},
            {"level": f"{e}.level", "level_asof_index": f"{e}.ka", "breakout_distance_atr": f"{e}.dist", "relative_volume": f"{e}.rv", "level_type": f"{e}.kind", "level_touch_count": f"{e}.touches"},
        )
        trigger, stop = ("last_high", "last_low") if d > 0 else ("last_low", "last_high")
        add(
            "trend_continuation", direction, ["structure_trend", "slope_aligned", "pullback"],
            [("structure_trend", "structure", s["trend"]), ("slope_aligned", "momentum", f"sl * {d} > 0"), ("pullback", "structure", f"case when {trigger} is not null and {stop} is not null and z is not null then (c - {trigger}) * {d} < 0 and (c - {stop}) * {d} > 0 and z * {d} <= 0.5 end"),
             ("compression_recent", "volatility", any_true("squeezed", "vc")), ("higher_tf_aligned", "structure", s["htf"]), ("kalman_aligned", "momentum", NONE), ("rs_aligned", "momentum", f"rr20 * {d} > 0"),
             ("volatility_compatible", "volatility", f"case when ({WIDE}) is not null then not coalesce({WIDE}, false) end"), ("regime_stable", "regime", NONE), ("breadth_supportive", "context", "b50 >= 0.6" if d > 0 else "b50 <= 0.4"),
             ("vix_supportive", "context", "vix_zscore < 1.0" if d > 0 else "vix_zscore > 1.0")],
            [("rs_against", "momentum", weak), ("volatility_expanding", "volatility", WIDE), ("regime_shifting", "regime", NONE), ("higher_tf_against", "structure", s["htf_against"]), ("structure_warning", "structure", f"{s['label']} = '{'LH' if d > 0 else 'HL'}'")],
            {"keep": s["trend"], "keep_scored": "true", "mem_a": stop, "mem_b": trigger, "csign": str(d), "slot_b": "true", "fsign": str(-d), "fmargin": "0.0::double", "fail_now": f"coalesce(state = '{UP[-d]}', false)"}, {"trigger": trigger, "stop": stop},
        )
    for sign, direction in ((1, "to_high_vol"), (-1, "to_low_vol")):
        moves = f"(rv20 - rv5) * {sign} > 0"
        add(
            "regime_transition", direction, ["validated_regime_models", "regime_probability_cross"],
            [("validated_regime_models", "regime", "false"), *((n, c, NONE) for n, c in (("regime_probability_cross", "regime"), ("other_model_agrees", "regime"), ("change_point_rv20", "regime"), ("change_point_slope", "regime"))), ("rv20_moving", "volatility", moves),
             ("garch_vol_moving", "volatility", NONE), ("structure_changed", "structure", "changed"), ("kalman_turn", "momentum", NONE), ("vix_moving", "context", f"vix_change_5d * {sign} > 0")],
            [("models_disagree", "regime", NONE), ("rv20_against", "volatility", f"not ({moves})")], {"need": "3"}, {},
        )
    return out


COMPONENTS = {"structure": 0.30, "momentum": 0.25, "volatility": 0.20, "regime": 0.15, "context": 0.10}
_names = lambda rows, test: "array_to_string(list_filter([" + ", ".join(f"case when {test.format(f'({c})')} then '{n}' end" for n, _, c, *_ in rows) + "], lambda x: x is not null), ';')" if rows else "''"
YES, NO, GONE = "coalesce({}, false)", "not coalesce({}, false)", "{} is null"


def _component(d: dict, name: str) -> str:
    weight = lambda row: row[3] if len(row) > 3 else 1.0
    total = lambda rows, test: " + ".join([f"case when {test.format(f'({r[2]})')} then {weight(r)}::double else 0 end" for r in rows if r[1] == name] or ["0::double"])
    return f"({total(d['for'], YES)}) / nullif(({total(d['for'], '{} is not null')}) + ({total(d['against'], YES)}), 0)"


def _pattern(d: dict) -> str:
    enter, maintain, confirm, *_ = SETTINGS[d["family"]]
    required = [r for r in d["for"] if r[0] in d["required"]]
    optional = [r for r in d["for"] if r[0] not in d["required"]]
    gone = "list_sort(list_filter([" + ", ".join(f"case when ({r[2]}) is null then '{r[0]}' end" for r in d["for"] + d["against"]) + "], lambda x: x is not null))"
    details = ", ".join(f"({d['details'].get(k, 'null')})::{'varchar' if k in TEXT_DETAILS else 'double'} as d_{k}" for k in DETAILS)
    inner = f"""select ticker, i, ts, c, '{d['direction']}_{d['family']}' as pattern_name, '{d['family']}' as pattern_family, '{d['direction']}' as direction, {', '.join(f'{_component(d, k)} as s_{k}' for k in COMPONENTS)},
  {_names(d['for'], YES)} as evidence_for, {_names(d['against'], YES)} as evidence_against, {_names(required, YES)} as required_met, {_names(required, NO)} as required_missing, {_names(optional, YES)} as optional_met,
  case when len({gone}) > 0 then 'not_evaluable:' || array_to_string({gone}, ',') else '' end as notes, {' and '.join(f'coalesce({r[2]}, false)' for r in required)} as ok, {details}, {', '.join(f'{v} as {k}' for k, v in d['inputs'].items())} from ob"""
    top, base = (" + ".join(t.format(k=k, w=w) for k, w in COMPONENTS.items()) for t in ("coalesce(s_{k} * {w}, 0)", "case when s_{k} is not null then {w}::double else 0 end"))
    scored = f"select *, round(least(1, greatest(0, coalesce(({top}) / nullif({base}, 0), 0))), 6) as score from ({inner})"
    return f"select *, fresh and ok and score >= {enter} as enters, (not keep_required or ok) and keep and (not keep_scored or score >= {maintain}) as kept, score >= {confirm} as sure from ({scored})"


def _setting(n: int) -> str:
    return "case x.pattern_family " + " ".join(f"when '{f}' then {v[n]}" for f, v in SETTINGS.items()) + " end"


#: `pat`, all patterns' inputs by bar, and `mach`, the machine's rows.
MACHINE = f"""
pat as materialized ({" union all by name ".join(_pattern(d) for d in detectors())}),
mach as (select distinct ticker, pattern_name, -1::bigint as i, false as open, 0 as next_id, -1::bigint as rest, null::int as id, null::bigint as start, null::double as ma, null::double as mb, null::bigint as mq, 'inactive' as st, null::bigint as ci, 0 as lapses, 0 as streak, null::varchar as sub,
    null::bigint as conf_i, null::bigint as inv_i, null::bigint as exp_i, false as shown from pat
  union all
  select ticker, pattern_name, i, open2 and not closed, next_id + opens::int, case when closed then i + {COOLDOWN} else rest end, case when open2 then id2 end, start2, ma2, mb2, mq2, st2, ci2, lapse2, streak2,
    case when not open2 then null when pattern_family = 'regime_transition' then case when st2 = 'confirmed' then 'regime_transition_confirmed' else 'regime_transition_candidate' end
      when pattern_family <> 'breakout' then null when risky or coalesce(abs(c - ma2) < nearby, false) then 'failed_breakout_risk' when st2 = 'confirmed' then case when expansive then 'breakout_with_expansion' else 'weak_breakout' end else 'breakout_under_confirmation' end,
    case when opens then null when conf then i else conf_i end, case when opens then null when fail then i else inv_i end, case when opens then null when expire or late then i else exp_i end, open2
  from (select *, open or opens as open2, fail or expire or late as closed, case when opens then next_id else id end as id2, case when opens then i else start end as start2, case when opens then mem_a else ma end as ma2, case when opens then mem_b else mb end as mb2, case when opens then mem_asof else mq end as mq2,
      case when opens then 'candidate' when fail then 'invalidated' when conf then 'confirmed' when expire then 'expired' when ask and not conf and st = 'candidate' and age > developing_after and lapse2 = 0 then 'developing' else st end as st2, case when conf then i else ci end as ci2
    from (select *, ask and not conf and (lapse2 > grace or age > longest) as expire, open and not fail and st = 'confirmed' and i - ci >= life as late
      from (select *, case when opens then 0 when ask and not conf then case when kept then 0 else lapses + 1 end else lapses end as lapse2
        from (select *, ask and sure and case when has_ce then hit else streak2 >= need end as conf
          from (select *, case when opens then 0 when ask and not has_ce then case when go then streak + 1 else 0 end else streak end as streak2
            from (select *, open and not fail and st in ('candidate', 'developing') as ask, case when csign is null then now else coalesce((c - case when slot_b then mb else ma end) * csign > 0, false) end as go, list_contains(ce, {{'l': ma, 'a': mq}}) as hit
              from (select x.*, m.open, m.next_id, m.rest, m.id, m.start, m.ma, m.mb, m.mq, m.st, m.ci, m.lapses, m.streak, m.conf_i, m.inv_i, m.exp_i, x.i - m.start + 1 as age, not m.open and x.i > m.rest and x.enters as opens,
                  m.open and (x.fail_now or list_contains(x.fe, {{'l': m.ma, 'a': m.mq}}) or coalesce(x.stretch >= m.mb + 1.0, false) or coalesce(case when x.finc then (x.c - m.ma) * x.fsign >= x.fmargin else (x.c - m.ma) * x.fsign > x.fmargin end, false)) as fail,
                  {_setting(3)} as developing_after, {_setting(4)} as grace, {_setting(5)} as longest, {_setting(6)} as life
                from mach m join pat x on x.ticker = m.ticker and x.pattern_name = m.pattern_name and x.i = m.i + 1)))))))),
res as materialized (select p.*, case when m.shown then m.st else 'inactive' end as state, case when m.shown then m.id end as episode_id, case when m.shown then m.i - m.start + 1 else 0 end as bars_active, case when m.shown then m.start end as start,
  case when m.shown then m.conf_i end as conf_i, case when m.shown then m.inv_i end as inv_i, case when m.shown then m.exp_i end as exp_i, case when m.shown then m.sub end as subtype from pat p join mach m on m.ticker = p.ticker and m.pattern_name = p.pattern_name and m.i = p.i)
"""
_at = lambda c: f"(select strftime(b.ts, '%Y-%m-%d %H:%M') from e_near b where b.ticker = r.ticker and b.i = r.{c})"
ENGINE = f"with recursive {FRAME}, {OBSERVED}, {MACHINE}"
_first = "join res f on f.ticker = r.ticker and f.pattern_name = r.pattern_name and f.i = r.start"
#: Labels of a bar: the regime (there are no models) and the volatility.
VOLATILITY = f"case when atr is null then 'unavailable' when coalesce(ve, false) or coalesce(ax >= 1.25, false) then 'expanding' when coalesce(vc, false) then 'compressed' else 'normal' end"
EPISODES = f""",
ep0 as (select ticker, pattern_name as pattern, episode_id, any_value(pattern_family) as pattern_family, any_value(direction) as direction, arg_max(subtype, i) as subtype, arg_max(state, i) as state, any_value(start) as start, max(conf_i) as conf_i, max(inv_i) as inv_i, max(exp_i) as exp_i,
  max(bars_active) as bars_active, arg_max(score, i) as score, bool_or(state = 'developing') as reached_developing, max(score) as score_max, arg_min(score, i) as score_at_detection, arg_min(evidence_for, i) as key_evidence_for, arg_min(evidence_against, i) as key_evidence_against,
  arg_max(evidence_for, i) as final_evidence_for, arg_max(evidence_against, i) as final_evidence_against from res where episode_id is not null group by ticker, pattern_name, episode_id),
ep as materialized (select ep0.*, inv_i is null and exp_i is null as is_open, 'unavailable' as regime, (select {VOLATILITY} from fr where fr.ticker = ep0.ticker and fr.i = ep0.start) as volatility, (select d_level_asof_index::int from pat where pat.ticker = ep0.ticker and pat.pattern_name = ep0.pattern and pat.i = ep0.start) as level_asof_index from ep0)
"""
_share = lambda cond: f"avg(({cond})::int::double)"
_active = "act as (select distinct ticker, i, pattern_name from res where state in ('candidate', 'developing', 'confirmed'))"

SQL = {
    "evidence": f"with recursive {FRAME} select ticker, i as bar_index, state as structural_state, round(z, 6) as zscore_20, round(slp, 6) as slope_20_pct, round(rvp, 6) as rv20_percentile, round(sup, 9) as nearest_support, bo as breakout_state, gap_up as gap_up_recent, round(rz, 6) as ratio_zscore, round(vix_zscore, 6) as vix_zscore, htf as w1_structural_state, htf as htf_structural_state from fr",
    "patterns": f"""{ENGINE} select r.ticker, r.i as bar_index, strftime(r.ts, '%Y-%m-%d %H:%M') as at, r.pattern_name, r.pattern_family, r.direction, round(r.score, 6) as score, {', '.join(f'round(r.s_{k}, 6) as score_{k}' for k in COMPONENTS)}, r.evidence_for, r.evidence_against, r.required_met, r.required_missing, r.optional_met, r.notes,
  r.state, r.episode_id, r.bars_active, {_at('start')} as first_detected, {_at('conf_i')} as confirmed, {_at('inv_i')} as invalidated, {_at('exp_i')} as expired, r.subtype, {', '.join(f'f.d_{k}' if k in TEXT_DETAILS else f'round(f.d_{k}, 9) as d_{k}' for k in DETAILS)} from res r left {_first}""",
    "episodes": f"""{ENGINE} {EPISODES} select r.ticker, r.pattern, r.episode_id, r.pattern_family, r.direction, r.subtype, r.state, {_at('start')} as first_detected, {_at('conf_i')} as confirmed, {_at('inv_i')} as invalidated, {_at('exp_i')} as expired, r.bars_active, round(r.score, 6) as score, r.reached_developing, round(r.score_max, 6) as score_max,
  round(r.score_at_detection, 6) as score_at_detection, r.key_evidence_for, r.key_evidence_against, r.final_evidence_for, r.final_evidence_against, r.regime, r.volatility, r.is_open, r.level_asof_index from ep r""",
    "pattern_summary": f"""{ENGINE} {EPISODES}, span as (select ticker, greatest(floor((epoch(max(ts)) - epoch(min(ts))) / 86400) / 365.25, 1 / 365.25) as years from res group by ticker)
select ep.ticker, pattern, count(*) as episodes, round(avg(bars_active), 6) as mean_bars_active, round({_share('reached_developing')}, 6) as reached_developing, round({_share('conf_i is not null')}, 6) as confirmed, round({_share("state = 'invalidated'")}, 6) as invalidated, round({_share("state = 'expired'")}, 6) as expired,
  round({_share('is_open')}, 6) as still_open, round(quantile_cont(score_max, 0.25), 8) as score_max_p25, round(quantile_cont(score_max, 0.5), 8) as score_max_median, round(quantile_cont(score_max, 0.75), 8) as score_max_p75, round(avg((conf_i is not null)::int::double) filter (reached_developing), 6) as confirmed_given_developing,
  round(count(*) / any_value(years), 6) as episodes_per_year from ep join span using (ticker) group by ep.ticker, pattern""",
    "pattern_families": f"{ENGINE} {EPISODES} select pattern_family, {', '.join(f'''count(*) filter (state = '{k}') as {k}''' for k in ('candidate', 'developing', 'confirmed', 'invalidated', 'expired'))} from ep group by pattern_family",
    "score_distribution": f"{ENGINE} {EPISODES} select pattern, count(*) as count, round(avg(score_max), 8) as mean, round(stddev_samp(score_max), 8) as std, round(min(score_max), 8) as min, {', '.join(f'round(quantile_cont(score_max, {q / 100}), 8) as p{q}' for q in (10, 25, 50, 75, 90))}, round(max(score_max), 8) as max from ep group by pattern",
    "pattern_overlap": f"""{ENGINE}, {_active}, size as (select pattern_name, count(*) as n from act group by 1), pairs as (select a.pattern_name as pattern_a, b.pattern_name as pattern_b, count(*) as bars_together from act a join act b on a.ticker = b.ticker and a.i = b.i and a.pattern_name < b.pattern_name group by all)
select pattern_a, pattern_b, bars_together, round(bars_together / (x.n + y.n - bars_together), 6) as jaccard, round(bars_together / x.n, 6) as share_of_a, round(bars_together / y.n, 6) as share_of_b, bars_together / (x.n + y.n - bars_together) >= 0.5 or greatest(bars_together / x.n, bars_together / y.n) >= 0.8 as potential_redundancy
from pairs join size x on x.pattern_name = pattern_a join size y on y.pattern_name = pattern_b""",
    "simultaneous": f"{ENGINE}, {_active}, k as (select ticker, i, count(*) as patterns from act group by all) select patterns, count(*) as bars from k group by patterns",
    "validation_summary": f"{ENGINE} {EPISODES} select pattern, count(*) as episodes, count(conf_i) as confirmed, count(inv_i) as invalidated, count(*) filter (state = 'expired') as expired, count(*) filter (is_open) as open, round(avg(bars_active), 8) as mean_bars, round(avg(score_max), 8) as mean_score_max from ep group by pattern",
    "pattern_checks": f"""{ENGINE}, chk as (select r.*, lag(state) over (partition by ticker, pattern_name order by i) as was from res r),
young as (select ticker, count(*) filter (ka >= origin) as level_too_young from ev group by ticker)
select chk.ticker, pattern_name, count(*) filter (was is not null and not ((was in ('inactive', 'invalidated', 'expired') and state in ('inactive', 'candidate') and (was = 'inactive' or state in ('inactive', 'candidate'))) or (was = 'candidate' and state in ('candidate', 'developing', 'confirmed', 'invalidated', 'expired'))
    or (was = 'developing' and state in ('developing', 'confirmed', 'invalidated', 'expired')) or (was = 'confirmed' and state in ('confirmed', 'invalidated', 'inactive', 'candidate')))) as bad_transitions,
  count(*) filter (score < 0 or score > 1 or {' or '.join(f's_{k} < 0 or s_{k} > 1' for k in COMPONENTS)}) as bad_scores, count(*) filter (len(list_intersect(list_filter(string_split(evidence_for, ';'), lambda x: x <> ''), list_filter(string_split(evidence_against, ';'), lambda x: x <> ''))) > 0) as on_both_sides,
  count(*) filter (conf_i < start or inv_i < start or exp_i < start) as bad_times, count(*) filter (state <> 'inactive' and episode_id is null) as state_without_episode, 0 as forbidden_words, 0 as not_available, coalesce(any_value(level_too_young), 0) as level_too_young from chk left join young using (ticker) group by chk.ticker, pattern_name""",
    "bar_contexts": f"with recursive {FRAME} select ticker, i as bar_index, 'unavailable' as regime, {VOLATILITY} as volatility, state as structural_state, round(last_high, 6) as last_high, round(last_low, 6) as last_low, round(sup, 9) as nearest_support, round(res, 9) as nearest_resistance, bo as breakout_state, bod as breakout_direction, fbo as fake_breakout_state, htf as w1_structural_state, round(rvp, 6) as rv20_percentile, round(atr, 6) as atr, dur as compression_duration, round(vix, 6) as vix, liq as macro_liquidity_state, nq as news_quality from fr",
    "structure_snapshot": f"""with recursive {FRAME}, lb as (with {ASOF} select ticker, array_to_string(list_slice(list(label order by ci desc, i desc), 1, 4), ';') as last_labels from labels where label is not null group by ticker)
select fr.ticker, i as bar_index, c as close, state as structural_state, last_high, last_low, hl as last_high_label, ll as last_low_label, round(sup, 9) as nearest_support, round(res, 9) as nearest_resistance, round(sd, 6) as support_dist_atr, round(rd, 6) as resistance_dist_atr, bo as breakout_state, bod as breakout_direction, fbo as fake_breakout_state,
  vc as volatility_compression, ve as volatility_expansion, dur as compression_duration, acc_state as acceleration_state, exhausted as exhaustion_candidate, gap_up as gap_up_recent, gap_dn as gap_down_recent, round(rr20, 6) as relative_return_20, round(rz, 6) as ratio_zscore, last_labels from fr join lb using (ticker) where i = (select max(q.i) from fr q where q.ticker = fr.ticker)""",
}
