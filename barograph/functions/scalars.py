"""Scalar expressions: None-propagating comparisons, three-valued any, labels, headline score, redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NY = "America/New_York"
#: Words of the fixed headline lexicon. Fixed values.
POSITIVE = ("beats", "beat", "growth", "surge", "surges", "upgrade", "upgrades", "raises", "raised", "record", "profit", "profits", "strong", "gain", "gains")
NEGATIVE = ("misses", "miss", "decline", "declines", "downgrade", "downgrades", "cuts", "cut", "loss", "losses", "weak", "lawsuit", "falls", "fall")
SECRET_PATTERN = r"(?i)((?:api_key|apikey|secret_key|token)=)[^&\s'\"]+"


def any_true(*values: Column) -> Column:
    """True if any is true; null only if all are null; else false (unlike SQL OR)."""
    some = reduce(lambda a, b: a | b, (F.coalesce(v, F.lit(False)) for v in values))
    none = reduce(lambda a, b: a & b, (v.isNull() for v in values))
    return F.when(some, True).when(none, F.lit(None).cast("boolean")).otherwise(False)


def bounded(x: Column) -> Column:
    """Clipped to [0, 1]; null, NaN and infinities become 0."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def headline_score(text: Column) -> Column:
    """(p - n) / (p + n) over the distinct lexicon words in a text; null where there are none."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))
    p = F.size(F.array_intersect(words, F.array(*map(F.lit, POSITIVE))))
    n = F.size(F.array_intersect(words, F.array(*map(F.lit, NEGATIVE))))
    return F.when(text.isNotNull() & (p + n > 0), (p - n) / (p + n).cast("double"))


def redact_secrets(text: Column, secrets: tuple[str, ...] = ()) -> Column:
    """Literal secrets and the values of credential parameters replaced by [REDACTED]."""
    for secret in sorted(filter(None, secrets), key=len, reverse=True):
        text = F.replace(text, F.lit(secret), F.lit("[REDACTED]"))
    return F.regexp_replace(text, SECRET_PATTERN, "$1[REDACTED]")


def ny_time(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, NY)


def ny_date(ts: Column) -> Column:
    return F.to_date(ny_time(ts))


def ny_clock(date: Column, hour: int, minute: int = 0) -> Column:
    """The UTC moment of a New York wall clock on a date."""
    return F.to_utc_timestamp(F.make_timestamp(F.year(date), F.month(date), F.day(date), F.lit(hour), F.lit(minute), F.lit(0)), NY)


def structural_label(high: Column, low: Column) -> Column:
    """State from the labels of the last swing high and low."""
    return (
        F.when(high.isNull() | low.isNull(), "insufficient_swings")
        .when((high == "HH") & (low == "HL"), "uptrend")
        .when((high == "LH") & (low == "LL"), "downtrend")
        .when((high == "EQ") | (low == "EQ") | ((high == "LH") & (low == "HL")), "range")
        .otherwise("transition")
    )
