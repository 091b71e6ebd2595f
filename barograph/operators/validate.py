"""Quality checks as single aggregates: one row per series with the number of violations of each rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.operators.resample import HOURS, minute_of_day, ohlcv
from barograph.operators.windows import KEYS, lag, series

C = F.col
PRICES = ("open", "high", "low", "close")


def check_bars(bars: DataFrame, order: str = "bar_index") -> DataFrame:
    x = bars.withColumn("_before", lag("timestamp", 1, series(order=order)))
    nulls = sum(C(c).isNull().cast("int") for c in (*PRICES, "volume", "timestamp"))
    return x.groupBy(*KEYS).agg(
        F.count("*").alias("bars"), F.count_if(nulls > 0).alias("null_rows"), F.count_if(C("timestamp") == C("_before")).alias("duplicate_timestamps"),
        F.count_if(C("timestamp") < C("_before")).alias("out_of_order"), F.count_if(C("high") < F.greatest("open", "close", "low")).alias("high_too_low"),
        F.count_if(C("low") > F.least("open", "close", "high")).alias("low_too_high"), F.count_if(C("volume") < 0).alias("negative_volume"))


def check_normalized(bars: DataFrame, start, end, session: str | None = None) -> DataFrame:
    """Window, session clock and, for weekly bars, provenance."""
    opening, closing = HOURS[session or "extended"]
    clock = minute_of_day(C("timestamp"))
    outside = F.count_if((clock < opening) | (clock >= closing)) if session else F.lit(0).cast("long")
    rules = [F.count_if((C("timestamp") < start) | (C("timestamp") >= end)).alias("outside_window"), outside.alias("outside_session")]
    if "source_last_timestamp" in bars.columns:
        rules += [F.count_if(C("source_last_timestamp") < C("timestamp")).alias("bad_provenance"), F.count_if(C("source_last_session_close") > end).alias("unclosed_source")]
    if "is_complete" in bars.columns:
        rules.append(F.count_if(C("is_complete").isNull()).alias("missing_flag"))
    return bars.groupBy(*KEYS).agg(*rules)


def check_aggregates(coarse: DataFrame, fine: DataFrame, keys: list[str], tolerance: float = 1e-8) -> DataFrame:
    """Re-aggregates `fine` by keys and counts the coarse bars that differ or have no match. Both sides hold the keys."""
    again = fine.groupBy(*keys).agg(*(c.alias(f"_{n}") for c, n in zip(ohlcv(), (*PRICES, "volume"), strict=True)))
    x = coarse.withColumn("_here", F.lit(True)).join(again.withColumn("_there", F.lit(True)), keys, "full_outer")
    differs = sum((F.abs(C(n) - C(f"_{n}")) > tolerance).cast("int") for n in (*PRICES, "volume")) > 0
    return x.agg(F.count_if(C("_there").isNull()).alias("only_coarse"), F.count_if(C("_here").isNull()).alias("only_fine"), F.count_if(differs).alias("different"), F.count_if(C("_here") & C("_there")).alias("matched"))


def check_feature_input(bars: DataFrame) -> DataFrame:
    """Closes finite and positive, timestamps present, unique and increasing."""
    x = bars.withColumn("_before", lag("timestamp"))
    bad = C("close").isNull() | F.isnan("close") | (F.abs("close") == float("inf")) | (C("close") <= 0)
    return x.groupBy(*KEYS).agg(F.count_if(bad).alias("bad_close"), F.count_if(C("timestamp").isNull() | (C("timestamp") <= C("_before"))).alias("bad_timestamp"))
