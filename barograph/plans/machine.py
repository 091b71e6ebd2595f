"""The pattern state machine: inactive, candidate, developing, confirmed, invalidated, expired.

On each bar an open episode is first tested for failure, then for confirmation, then for lapses and age; a confirmed one
closes after its time to live. On the bar that opens an episode nothing is tested. After a close the machine rests.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import functions as F

STATES = ("inactive", "candidate", "developing", "confirmed", "invalidated", "expired")


@dataclass(frozen=True)
class Machine:
    enter_score: float = 0.40
    maintain_score: float = 0.25
    confirm_score: float = 0.35
    developing_after: int = 2
    grace: int = 2
    max_pending: int = 10
    time_to_live: int = 5
    cooldown: int = 3


_event = replace(Machine(), enter_score=0.0, confirm_score=0.0)
MACHINES = {
    "exhaustion": Machine(), "breakout": replace(_event, max_pending=3, time_to_live=10, developing_after=1), "failed_breakout": replace(_event, max_pending=6, time_to_live=10, developing_after=1),
    "mean_reversion": Machine(), "trend_continuation": Machine(max_pending=15), "regime_transition": replace(_event, developing_after=1), "divergence": replace(_event, max_pending=15),
}

_none = lambda kind: lambda: F.lit(None).cast(kind)
_value = lambda v: lambda: F.lit(v)
#: Inputs of the machine: type and default. mem_a, mem_b and mem_asof are what an episode remembers of its first bar.
HOOKS = {
    "fresh": ("boolean", _value(True)), "keep": ("boolean", _value(True)), "keep_required": ("boolean", _value(False)), "keep_scored": ("boolean", _value(False)),
    "mem_a": ("double", _none("double")), "mem_b": ("double", _none("double")), "mem_asof": ("int", _none("int")),
    "confirm_now": ("boolean", _none("boolean")), "confirm_sign": ("int", _none("int")), "confirm_slot": ("string", _value("a")), "confirm_need": ("int", _value(1)),
    "confirm_events": ("array<struct<level:double,asof:int>>", _none("array<struct<level:double,asof:int>>")), "fail_now": ("boolean", _value(False)),
    "fail_sign": ("int", _none("int")), "fail_margin": ("double", _none("double")), "fail_inclusive": ("boolean", _value(False)),
    "fail_events": ("array<struct<level:double,asof:int>>", _none("array<struct<level:double,asof:int>>")), "stretch": ("double", _none("double")),
    "near": ("double", _none("double")), "risky": ("boolean", _value(False)), "expansive": ("boolean", _value(False)), "kind": ("string", _value("")),
}


@dataclass
class Episode:
    number: int
    start: int
    first_detected_at: object
    mem_a: float | None
    mem_b: float | None
    mem_asof: int | None
    details: str | None
    state: str = "candidate"
    confirmed_index: int | None = None
    confirmed_at: object = None
    invalidated_at: object = None
    expired_at: object = None
    lapses: int = 0
    streak: int = 0
    subtype: str | None = None


@dataclass
class Tracker:
    """What the machine carries from bar to bar; plain data, so that a stream can keep it as state."""

    episode: Episode | None = None
    rest_until: int = -1
    next_number: int = 0
    i: int = field(default=-1)


def missing(x) -> bool:
    return x is None or (isinstance(x, float) and math.isnan(x))


def true(x) -> bool:
    return not missing(x) and bool(x)


def same_level(events, e: Episode) -> bool:
    return events is not None and any(x["level"] == e.mem_a and x["asof"] == e.mem_asof for x in events)


def failed(row: dict, e: Episode) -> bool:
    if true(row["fail_now"]) or same_level(row["fail_events"], e):
        return True
    if not missing(row["stretch"]) and not missing(e.mem_b) and row["stretch"] >= e.mem_b + 1.0:
        return True
    if missing(row["fail_sign"]) or missing(row["fail_margin"]) or missing(e.mem_a):
        return False
    beyond = (row["close"] - e.mem_a) * row["fail_sign"]
    return beyond >= row["fail_margin"] if true(row["fail_inclusive"]) else beyond > row["fail_margin"]


def confirmed(row: dict, e: Episode) -> bool:
    """Advances the episode's streak, so it may only be asked where the machine asks it."""
    if row["confirm_events"] is not None:
        return same_level(row["confirm_events"], e)
    if missing(row["confirm_sign"]):
        now = true(row["confirm_now"])
    else:
        level = e.mem_b if row["confirm_slot"] == "b" else e.mem_a
        now = not missing(level) and (row["close"] - level) * row["confirm_sign"] > 0
    e.streak = e.streak + 1 if now else 0
    return e.streak >= row["confirm_need"]


def kept(row: dict, m: Machine) -> bool:
    if true(row["keep_required"]) and not true(row["required_ok"]):
        return False
    return true(row["keep"]) and (not true(row["keep_scored"]) or row["score"] >= m.maintain_score)


def subtype(row: dict, e: Episode) -> str | None:
    if row["kind"] == "regime":
        return "regime_transition_confirmed" if e.state == "confirmed" else "regime_transition_candidate"
    if row["kind"] != "breakout":
        return None
    if true(row["risky"]) or (not missing(row["near"]) and abs(row["close"] - e.mem_a) < row["near"]):
        return "failed_breakout_risk"
    if e.state == "confirmed":
        return "breakout_with_expansion" if true(row["expansive"]) else "weak_breakout"
    return "breakout_under_confirmation"


def step(t: Tracker, row: dict, m: Machine) -> dict:
    """One bar: updates the tracker and returns the bar's result."""
    t.i += 1
    i, stamp, closed = t.i, row["timestamp"], False
    e = t.episode
    if e is None:
        if i > t.rest_until and true(row["fresh"]) and true(row["required_ok"]) and row["score"] >= m.enter_score:
            e = t.episode = Episode(t.next_number, i, stamp, *(None if missing(row[k]) else row[k] for k in ("mem_a", "mem_b", "mem_asof")), row["memory_now"])
            t.next_number += 1
    else:
        age, pending = i - e.start + 1, e.state in ("candidate", "developing")
        if failed(row, e):
            e.state, e.invalidated_at, closed = "invalidated", stamp, True
        elif pending and confirmed(row, e) and row["score"] >= m.confirm_score:
            e.state, e.confirmed_at, e.confirmed_index = "confirmed", stamp, i
        elif pending:
            e.lapses = 0 if kept(row, m) else e.lapses + 1
            if e.lapses > m.grace or age > m.max_pending:
                e.state, e.expired_at, closed = "expired", stamp, True
            elif e.state == "candidate" and age > m.developing_after and e.lapses == 0:
                e.state = "developing"
        elif i - e.confirmed_index >= m.time_to_live:
            e.expired_at, closed = stamp, True
    if e is None:
        return {"state": "inactive", "episode_id": None, "bars_active": 0, "first_detected_at": None, "confirmed_at": None, "invalidated_at": None, "expired_at": None, "subtype": None, "details": None}
    e.subtype = subtype(row, e) or e.subtype
    if closed:
        t.episode, t.rest_until = None, i + m.cooldown
    return {"state": e.state, "episode_id": e.number, "bars_active": i - e.start + 1, "first_detected_at": e.first_detected_at, "confirmed_at": e.confirmed_at, "invalidated_at": e.invalidated_at, "expired_at": e.expired_at, "subtype": e.subtype, "details": e.details}


def run_machine(rows: list[dict], m: Machine) -> list[dict]:
    t = Tracker()
    return [step(t, row, m) for row in rows]
