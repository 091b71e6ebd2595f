"""The evidence frame: one row per bar with everything known at its close."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.operators import features as X
from barograph.operators import structure as S
from barograph.operators.joins import asof_join
from barograph.operators.resample import close_times, complete_bars
from barograph.operators.windows import KEYS, lag, series
from barograph.sources.scratch import stash

C = F.col
PREFIX = {"1Week": "w1", "1Day": "d1", "4Hour": "h4", "1Hour": "h1"}
HIGHER = {"1Hour": "4Hour", "4Hour": "1Day", "1Day": "1Week", "1Week": None}
ATTACHED = ["structural_state", "slope", "zscore_20", "acceleration_state", "breakout_state", "volatility_expansion"]
QUANT = [
    "hmm_p_high", "hmm_p_high_lag", "markov_p_high", "markov_p_high_lag", "kalman_level", "kalman_level_change", "kalman_level_change_lag", "garch_vol", "garch_vol_ratio",
    "cp_rv20_recent", "cp_slope_recent", "cp_rv20_age", "cp_slope_age", "hurst", "permutation_entropy", "quant_fit_index",
]
INDICATORS = {"momentum_divergence": ("momentum_20", "momentum"), "slope_divergence": ("slope_20_pct", "momentum"), "rs_divergence": ("price_benchmark_ratio", "momentum"), "volume_divergence": ("relative_volume", "momentum"), "breadth_divergence": ("breadth_sma50", "context")}


def quant_types() -> dict[str, str]:
    kinds = {c: "double" for c in QUANT}
    return kinds | {"cp_rv20_recent": "boolean", "cp_slope_recent": "boolean", "quant_fit_index": "int"}


def build_evidence(bars: DataFrame, timeframe: str, benchmark: DataFrame | None = None, quant: DataFrame | None = None, external=None, light: bool = False) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(frame, breakout events or None, swings) of bars with ticker, timeframe, timestamp, bar_index and prices.

    light leaves levels, breakouts, gaps and strength out, for context timeframes. `external` is a function that adds the
    external columns to bars with close_time; without it they are null. All windows share one partitioning. Each layer is
    written once: several read it, and a single plan of all layers takes longer to optimise than to run.
    """
    bars = stash(close_times(complete_bars(bars), timeframe), "bars")
    x = X.recent_flags(X.compression_features(X.acceleration_features(X.rv_percentile(X.statistical_features(X.with_atr(bars))))))
    x = x.withColumn("slope_20_pct", C("rolling_slope_20") / C("close"))
    swings = S.confirmed_swings(bars)
    swings = stash(swings, "swings")
    x = S.structure_asof(stash(x, "features"), swings)
    if light:
        return x.withColumn("breakout_state", F.lit("inactive")), None, swings
    history = stash(S.levels_history(bars, swings), "levels")
    events = stash(S.detect_breakouts(bars, history), "events")
    x = S.breakout_recency(S.nearest_levels(x, history), events)
    if timeframe == "1Day":
        x = S.filtered_gaps(x, S.detect_gaps(bars))
    else:
        x = x.withColumns({c: F.lit(None).cast("boolean") for c in ("gap_up_recent", "gap_down_recent")})
    x = stash(x, "structure")
    if benchmark is not None:
        x = X.relative_strength(x, complete_bars(benchmark))
    else:
        x = x.withColumns({c: F.lit(None).cast("double") for c in X.STRENGTH if c != "benchmark_available"} | {"benchmark_available": F.lit(False)})
    if quant is not None:
        x = x.join(quant.select(*KEYS, "bar_index", *QUANT), [*KEYS, "bar_index"], "left")
    else:
        x = x.withColumns({c: F.lit(None).cast(t) for c, t in quant_types().items()})
    if external is not None:
        x = external(stash(x, "evidence"))
    else:
        nulls = {"vix": "double", "vix_zscore": "double", "vix_change_5d": "double", "breadth_sma50": "double", "breadth_sma50_change5": "double", "macro_liquidity_state": "string", "news_sentiment_7d": "double", "news_count_7d": "long"}
        x = x.withColumns({c: F.lit(None).cast(t) for c, t in nulls.items()} | {"macro_status": F.lit("missing"), "news_quality": F.lit("missing")})
    return x.withColumn("htf_structural_state", F.lit(None).cast("string")), events, swings


def attach_timeframe(frame: DataFrame, other: DataFrame, timeframe: str, primary: str) -> DataFrame:
    """The last bar of another timeframe closed by each close, under its prefix; the next higher one also as htf_structural_state."""
    prefix = PREFIX[timeframe]
    x = asof_join(frame, other.select("ticker", "close_time", *ATTACHED), "close_time", "close_time", by=["ticker"], columns=["close_time", *ATTACHED], prefix=f"{prefix}_")
    return x.withColumn("htf_structural_state", C(f"{prefix}_structural_state")) if HIGHER[primary] == timeframe else x


def events_by_bar(frame: DataFrame, events: DataFrame) -> DataFrame:
    """frame with, per bar, the events seen there and the latest candidate and failure of each side of up to 5 bars ago."""
    row = F.struct("state", "direction", "level", "level_asof_index", "level_touch_count", "level_type", "distance_atr", "relative_volume", "failure_bars", "bar_index", "timestamp")
    order = F.struct(-F.coalesce("level_touch_count", F.lit(0)), C("distance_atr"), C("level"))
    picks = {f"_{k}_{side}": F.min_by(F.when((C("state") == state.format(side)) & (C("direction") == side), row), F.when((C("state") == state.format(side)) & (C("direction") == side), order)) for k, state in (("cand", "breakout_candidate"), ("fake", "fake_breakout_{}")) for side in ("up", "down")}
    marks = events.groupBy(*KEYS, "bar_index").agg(F.collect_list(F.struct("state", "direction", "level", "level_asof_index")).alias("events_here"), *(v.alias(k) for k, v in picks.items()))
    x = frame.join(marks, [*KEYS, "bar_index"], "left")
    recent = series().rowsBetween(-5, 0)
    return x.withColumns({k: F.last(k, True).over(recent) for k in picks})


def pivots_by_bar(frame: DataFrame, swings: DataFrame) -> DataFrame:
    """frame with the last confirmed pivot pair of each side: indicator values at both pivots and the neckline between them."""
    w = Window.partitionBy(*KEYS, "type").orderBy("confirmation_index", "bar_index")
    names = [column for column, _ in INDICATORS.values()]
    at = frame.select(*KEYS, "bar_index", F.struct(*(C(c).cast("double").alias(c) for c in names)).alias("_v"), C("high").alias("_h"), C("low").alias("_l"))
    s = swings.select(*KEYS, "type", "bar_index", "confirmation_index", "price_level").join(at.drop("_h", "_l"), [*KEYS, "bar_index"])
    s = s.withColumns({"_old": lag("_v", 1, w), "_old_index": lag("bar_index", 1, w)})
    span = s.where("_old_index is not null").withColumn("_i", F.explode(F.sequence(F.least("_old_index", "bar_index"), F.greatest("_old_index", "bar_index"))))
    span = span.select(*KEYS, "type", C("bar_index").alias("_b"), C("_i").alias("bar_index")).join(at.drop("_v"), [*KEYS, "bar_index"])
    neck = span.groupBy(*KEYS, "type", C("_b").alias("bar_index")).agg(F.when(C("type") == "swing_high", F.min("_l")).otherwise(F.max("_h")).alias("_neck"))
    s = s.join(neck, [*KEYS, "type", "bar_index"], "left")
    pivot = F.struct(C("_v").alias("new"), C("_old").alias("old"), C("bar_index").alias("index"), C("_old_index").alias("old_index"), C("price_level").alias("price"), C("_neck").alias("neck"))
    pick = lambda kind: F.max_by(F.when(C("type") == kind, pivot), F.when(C("type") == kind, C("bar_index")))
    marks = s.groupBy(*KEYS, C("confirmation_index").alias("bar_index")).agg(pick("swing_high").alias("_ph"), pick("swing_low").alias("_pl"))
    so_far = series().rowsBetween(Window.unboundedPreceding, 0)
    return frame.join(marks, [*KEYS, "bar_index"], "left").withColumns({"_ph": F.last("_ph", True).over(so_far), "_pl": F.last("_pl", True).over(so_far)})
