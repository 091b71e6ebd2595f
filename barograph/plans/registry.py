"""The registered queries: every operator on whole tables. plans.oracle holds their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.functions import scalars
from barograph.operators import context, features, joins, models, resample, scores, structure, validate
from barograph.plans import engine, evidence, fixtures
from barograph.sources import readers
from barograph.sources.readers import ticks, walk_bars

C = F.col
FOLD_STEP = 63


def rounded(df: DataFrame, keys: list[str], columns: list[str], digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    exact = {"price_level", "level", "nearest_support", "nearest_resistance"}  # means of cents
    return df.select(*keys, *(F.round(c, 9 if c in exact else digits).alias(c) if kinds[c] == "double" else C(c) for c in columns))


def _stats(bars):
    return features.statistical_features(bars)


def _swings(bars):
    return structure.confirmed_swings(bars)


def _history(bars):
    return structure.levels_history(bars, _swings(bars))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is each series' market structure now?"""
    x = structure.structural_state(structure.classify_swings(_swings(walk_bars(spark, sf_dir))))
    return x.select("ticker", "high_label", "low_label", "structural_state")


K = ["ticker", "bar_index"]


def q_walk_bars(s, d):
    return walk_bars(s, d).select("ticker", C("session_date").cast("string").alias("session_date"), "bar_index", "open", "high", "low", "close", "volume")


def q_atr(s, d):
    return rounded(features.with_atr(walk_bars(s, d)), K, ["atr"])


def q_returns(s, d):
    return rounded(_stats(walk_bars(s, d)), K, ["simple_return", "log_return", "momentum_5", "momentum_20", "drawdown"], 9)


def q_rolling(s, d):
    return rounded(_stats(walk_bars(s, d)), K, ["rolling_mean_20", "rolling_std_20", "zscore_20", "realized_volatility_20", "rolling_slope_20"])


def q_moments(s, d):
    return rounded(_stats(walk_bars(s, d)), K, ["rolling_skew_20", "rolling_kurtosis_20", "autocorr_lag1", "autocorr_lag5"])


def q_max_drawdown(s, d):
    return rounded(_stats(walk_bars(s, d)), K, ["rolling_max_drawdown_60"], 9)


def q_diagnostics(s, d):
    return rounded(models.diagnostics(_stats(walk_bars(s, d))), ["ticker"], ["nobs", "jarque_bera", "ljung_box"], 4)


def q_adf(s, d):
    return rounded(models.diagnostics(_stats(walk_bars(s, d))), ["ticker"], ["adf", "adf_lags", "adf_nobs"], 4)


def q_acceleration(s, d):
    return rounded(features.acceleration_features(walk_bars(s, d)), K, ["slope", "slope_change", "acceleration", "distance_to_mean", "price_zscore", "cumulative_log_return", "relative_volume", "atr_expansion"])


def q_acceleration_states(s, d):
    return features.acceleration_features(walk_bars(s, d)).select(*K, "acceleration_state", "exhaustion_candidate")


def q_compression(s, d):
    return rounded(features.compression_features(walk_bars(s, d)), K, [*features.COMPRESSION_PARTS, "volatility_compression", "volatility_expansion", "compression_duration"])


def q_relative_strength(s, d):
    b = walk_bars(s, d)
    return rounded(features.relative_strength(b, fixtures.benchmark(b)), K, features.STRENGTH)


def q_asset_liquidity(s, d):
    return rounded(features.asset_liquidity(walk_bars(s, d), 1e6), K, ["dollar_volume", "relative_volume", "turnover", "volatility_per_volume", "overnight_gap"])


def q_vix(s, d):
    x = fixtures.vix(s, d).withColumns({"day": F.date_format("observation_date", "yyyy-MM-dd"), "available": F.date_format("available_at", "yyyy-MM-dd HH:mm")})
    return rounded(x, ["day", "available"], ["vix", "vix_change_1d", "vix_change_5d", "vix_zscore_252d"])


def q_breadth(s, d):
    x = fixtures.breadth(walk_bars(s, d)).withColumn("day", F.date_format(scalars.ny_time(C("timestamp")), "yyyy-MM-dd"))
    return rounded(x, ["day"], ["members_available", "breadth_sma20", "breadth_sma50", "breadth_sma200", "advances", "declines", "advance_decline_ratio", "new_highs_252d", "new_lows_252d"])


def q_rv_percentile(s, d):
    return rounded(features.rv_percentile(_stats(walk_bars(s, d))), K, ["rv20_percentile"])


def q_recent_flags(s, d):
    x = features.recent_flags(features.compression_features(features.acceleration_features(walk_bars(s, d))))
    return x.select(*K, "accel_up_recent", "accel_down_recent", "compression_recent")


def q_har(s, d):
    return rounded(features.har_predictors(_stats(walk_bars(s, d))), K, ["har_daily", "har_weekly", "har_monthly"], 9)


def q_swings(s, d):
    return _swings(walk_bars(s, d)).select("ticker", "type", "bar_index", "confirmation_index", "price_level")


def q_swing_labels(s, d):
    return structure.classify_swings(_swings(walk_bars(s, d))).select("ticker", "type", "bar_index", "structure_label")


def q_atr_reversal(s, d):
    return structure.atr_reversal_swings(walk_bars(s, d)).select("ticker", "type", "bar_index", "confirmation_index", "price_level", "confirmation_lag_bars")


def q_structure_asof(s, d):
    b = walk_bars(s, d)
    return structure.structure_asof(b, _swings(b)).select(*K, "structural_state", "last_high", "last_low", "prev_high_index", "prev_low_index", "last_high_label", "last_low_label", "new_swing_high", "new_swing_low", "structure_changed_recent")


def q_levels_history(s, d):
    x = _history(walk_bars(s, d))
    return rounded(x, ["ticker", "asof_index"], ["price_level", "type", "touch_count", "distance_from_current_price", "strength_score"], 4)


def q_levels_asof(s, d):
    b = walk_bars(s, d)
    return rounded(structure.levels_asof(b, _swings(b), fixtures.at("1996-06-28 12:00:00")), ["ticker", "asof_index"], ["price_level", "type", "touch_count"], 4)


def q_nearest_levels(s, d):
    b = features.with_atr(walk_bars(s, d))
    return rounded(structure.nearest_levels(b, _history(b.drop("atr"))), K, ["nearest_support", "nearest_resistance", "support_touches", "resistance_touches", "support_dist_atr", "resistance_dist_atr"], 4)


def q_breakouts(s, d):
    b = walk_bars(s, d)
    return rounded(structure.detect_breakouts(b, _history(b)), K, ["origin_index", "level", "level_type", "level_touch_count", "direction", "state", "distance_atr", "relative_volume", "outside_bars", "retest", "failure_bars", "confidence"], 4)


def _fixed(s, b):
    # Fixed levels: each series' prices at whole hundreds and fifties, known from the first of 1994 on.
    levels = s.range(1, 101).select((C("id") * 5).cast("double").alias("price_level"), fixtures.at("1994-01-01").alias("available_at"))
    return b.select("ticker", "timeframe").distinct().join(F.broadcast(levels))


def q_breakouts_fixed(s, d):
    b = walk_bars(s, d)
    return rounded(structure.detect_breakouts_fixed_levels(b, _fixed(s, b)), K, ["origin_index", "level", "direction", "state", "distance_atr", "outside_bars", "retest", "failure_bars", "confidence"], 4)


def q_breakout_recency(s, d):
    b = walk_bars(s, d)
    x = structure.breakout_recency(b, structure.detect_breakouts_fixed_levels(b, _fixed(s, b)))
    return x.select(*K, "breakout_state", "breakout_direction", "breakout_age", "fake_breakout_state", "fake_breakout_age")


def q_gaps(s, d):
    return rounded(structure.detect_gaps(walk_bars(s, d)), ["ticker", "bar_index", "gap_index"], ["type", "size_abs", "size_pct", "size_atr", "filled", "time_to_fill_bars", "state"])


def q_gap_filter(s, d):
    b = walk_bars(s, d)
    return structure.filtered_gaps(b, structure.detect_gaps(b)).select(*K, "gap_up_recent", "gap_down_recent")


def q_gap_counts(s, d):
    return structure.gap_counts(structure.detect_gaps(walk_bars(s, d))).drop("timeframe")


def q_check_bars(s, d):
    return validate.check_bars(fixtures.damaged(walk_bars(s, d))).drop("timeframe")


def q_check_feature_input(s, d):
    return validate.check_feature_input(walk_bars(s, d)).drop("timeframe")


def q_range_filter(s, d):
    b = walk_bars(s, d)
    x = b.where((C("timestamp") >= fixtures.at("1995-01-01")) & (C("timestamp") < fixtures.at("1996-01-01")))
    return x.select(*K, "open", "high", "low", "close", "volume")


def q_session_bars(s, d):
    x = resample.session_filter(fixtures.intraday(s, d), "regular")
    return rounded(x.withColumn("at", F.date_format("timestamp", "yyyy-MM-dd HH:mm")), ["ticker", "at"], ["open", "high", "low", "close", "volume"], 4)


def _blocks(s, d, session, hours):
    bars = fixtures.intraday(s, d, 15 if session == "regular" else 60)
    x = resample.intraday_aggregate(resample.session_filter(bars, session), session, hours, f"{hours}Hour")
    return rounded(x.withColumn("at", F.date_format("timestamp", "yyyy-MM-dd HH:mm")), ["ticker", "at"], ["open", "high", "low", "close", "volume", "is_complete"], 4)


def q_intraday_4h(s, d):
    return _blocks(s, d, "regular", 4)


def q_intraday_1h(s, d):
    return _blocks(s, d, "regular", 1)


def q_intraday_extended_4h(s, d):
    return _blocks(s, d, "extended", 4)


def _request(bars):
    """The request that covers every session: from midnight of the first day to the close of the last."""
    first, last = bars.agg(F.min("session_date"), F.max("session_date")).first()
    return scalars.ny_clock(F.lit(first).cast("date"), 0), scalars.ny_clock(F.lit(last).cast("date"), 16)


def _weekly(s, d):
    b = walk_bars(s, d)
    return resample.weekly(b, *_request(b))


def q_weekly(s, d):
    x = _weekly(s, d).withColumns({"at": F.date_format("timestamp", "yyyy-MM-dd HH:mm"), "closed": F.date_format("source_last_session_close", "yyyy-MM-dd HH:mm")})
    return rounded(x, ["ticker", "at", "closed"], ["open", "high", "low", "close", "volume", "is_complete"], 4)


def q_complete_weeks(s, d):
    x = resample.complete_bars(_weekly(s, d)).withColumn("at", F.date_format("timestamp", "yyyy-MM-dd HH:mm"))
    return rounded(x, ["ticker", "at"], ["close"], 4)


def q_check_normalized(s, d):
    return validate.check_normalized(_weekly(s, d), fixtures.at("1992-01-01"), fixtures.at("1998-01-01")).drop("timeframe")


def q_check_aggregates(s, d):
    b = walk_bars(s, d).withColumn("week", F.to_date(F.date_trunc("week", C("session_date").cast("timestamp"))))
    coarse = _weekly(s, d).withColumn("week", F.to_date(F.date_trunc("week", scalars.ny_time(C("timestamp")))))
    return validate.check_aggregates(coarse, b, ["ticker", "week"])


def q_normalize(s, d):
    """Every timeframe and session through the dispatch, from the timeframe that readers.source_timeframe() names."""
    day, out = walk_bars(s, d), []
    first, last = _request(day)
    for timeframe, session in (("15Min", "regular"), ("1Hour", "regular"), ("4Hour", "regular"), ("1Hour", "extended"), ("4Hour", "extended"), ("1Day", "regular"), ("1Week", "regular")):
        source = readers.source_timeframe(timeframe, session)
        bars = day if source == "1Day" else fixtures.intraday(s, d, 15 if source == "15Min" else 60)
        x = resample.normalize(bars, timeframe, session, first, last)
        x = x.withColumns({"kind": F.lit(f"{timeframe} {session}"), "at": F.date_format("timestamp", "yyyy-MM-dd HH:mm")})
        out.append(rounded(x, ["kind", "ticker", "at"], ["open", "high", "low", "close", "volume"], 4))
    return reduce(DataFrame.unionByName, out)


def q_raw_bars(s, d):
    """Bars written as files of two feeds and read back for one symbol, feed and inclusive range, then cut to [start, end)."""
    feed = F.when(C("bar_index") % 3 == 0, "sip").otherwise("iex")
    path = fixtures.written(walk_bars(s, d).select(C("ticker").alias("symbol"), "timestamp", "open", "high", "low", "close", "volume", feed.alias("feed"), "timeframe"), "raw", "parquet")
    raw = readers.raw_bars(s, path, "asia", "1Day", "1995-03-01", "1998-03-01 05:00:00", "sip")
    x = readers.normalized_frame(raw, "1995-06-01", "1998-03-01 05:00:00")
    return x.select("ticker", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "open", "high", "low", "close", "volume")


def q_macro_files(s, d):
    """Vintages from JSON lines and current revisions from CSV; rows without a number go."""
    m = fixtures.macro(s, d).where("series = 'fed_assets'")
    day = F.date_format("observation_date", "yyyy-MM-dd").alias("date")
    release = F.date_format(C("available_at") - F.expr("interval 1 day"), "yyyy-MM-dd").alias("realtime_start")
    value = F.when(C("value") % 5 == 0, ".").otherwise(C("value").cast("string")).alias("value")
    vintages = readers.macro_vintages(s, fixtures.written(m.select(day, release, value), "vintages", "json"), "fed_assets")
    current = readers.macro_revisions(s, fixtures.written(m.where(F.dayofmonth("observation_date") < 9).select(day, value), "revisions", "csv"), "rrp", "2002-01-01")
    x = vintages.unionByName(current)
    return x.select("series", F.date_format("observation_date", "yyyy-MM-dd").alias("day"), F.date_format("available_at", "yyyy-MM-dd").alias("available"), F.round("value", 6).alias("value"), "source", "unit", "asof_safe")


def q_vix_file(s, d):
    """Closes from CSV with dates that repeat."""
    x = fixtures.vix(s, d).select(F.date_format("observation_date", "MM/dd/yyyy").alias("Date"), C("vix").alias("VIX Close"))
    twice = x.unionByName(x.where("substring(Date, 4, 2) = '07'").withColumn("VIX Close", C("VIX Close") - 1))
    return readers.vix_closes(s, fixtures.written(twice, "vix", "csv")).select(F.date_format("observation_date", "yyyy-MM-dd").alias("day"), F.round("vix", 6).alias("vix"))


def q_news_file(s, d):
    """News from JSON lines, available when last touched, scored from its headline."""
    x = fixtures.news(s, d).select("ticker", "headline", F.lit("").alias("summary"), F.lit("wire").alias("source"), C("published_at").alias("created_at"), F.when(C("doc_id") % 3 > 0, C("available_at")).alias("updated_at"))
    got = readers.news(s, fixtures.written(x, "news", "json"))
    return got.select("ticker", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published"), F.date_format("available_at", "yyyy-MM-dd HH:mm").alias("available"), F.round("score", 9).alias("score"))


def q_forecast_file(s, d):
    """Forecast rows written as CSV, read with their schema and scored."""
    x = fixtures.forecasts(s, d)
    path = fixtures.written(x.select("asset", "model", F.lit(None).cast("timestamp").alias("train_start"), F.lit(None).cast("timestamp").alias("train_end"), C("test_date").cast("timestamp").alias("test_date"), "forecast", "actual", "error", "parameter"), "forecasts", "csv")
    return rounded(scores.score_rows(readers.forecasts(s, path), "return"), ["asset", "model"], ["n", "mae", "rmse", "error_std"], 9)


def q_close_times(s, d):
    day = resample.close_times(walk_bars(s, d).drop("close_time"), "1Day").select("ticker", F.lit("1Day").alias("kind"), F.date_format("timestamp", "yyyy-MM-dd HH:mm").alias("at"), F.date_format("close_time", "yyyy-MM-dd HH:mm").alias("closes"))
    hour = resample.close_times(fixtures.intraday(s, d, 60), "1Hour").select("ticker", F.lit("1Hour").alias("kind"), F.date_format("timestamp", "yyyy-MM-dd HH:mm").alias("at"), F.date_format("close_time", "yyyy-MM-dd HH:mm").alias("closes"))
    return day.unionByName(hour)


def q_truncate(s, d):
    x = resample.truncate(fixtures.close_of(walk_bars(s, d)), fixtures.at("1996-03-15 21:00:00"))
    return x.select(*K, "close")


def q_asof_timeframe(s, d):
    week = resample.close_times(_weekly(s, d), "1Week").select("ticker", "close_time", C("close").alias("week_close"))
    x = joins.asof_join(fixtures.close_of(walk_bars(s, d)), week, "close_time", "close_time", by=["ticker"], columns=["week_close"])
    return x.select(*K, "week_close")


def q_asof_vix(s, d):
    x = joins.asof_join(fixtures.close_of(walk_bars(s, d)), fixtures.vix(s, d).select("available_at", "vix", "vix_change_5d"), "close_time", "available_at")
    return rounded(x, K, ["vix", "vix_change_5d"])


def q_news(s, d):
    return rounded(context.news_by_bar(fixtures.close_of(walk_bars(s, d)), fixtures.news(s, d)), K, ["news_count_1d", "news_count_7d", "news_scored_7d", "news_sentiment_1d", "news_sentiment_7d", "news_quality"])


def q_macro_asof(s, d):
    return context.macro_asof(fixtures.macro(s, d), fixtures.at("1996-07-01 12:00:00")).select("series", F.date_format("observation_date", "yyyy-MM-dd").alias("day"), "value")


def q_macro_history(s, d):
    m = fixtures.macro(s, d).where(C("available_at") <= fixtures.at("1996-07-01 12:00:00"))
    x = context.macro_liquidity_history(m).withColumn("day", F.date_format("observation_date", "yyyy-MM-dd"))
    return rounded(x, ["day"], ["net_liquidity", "net_liquidity_1w_change", "net_liquidity_4w_change", "net_liquidity_zscore_52w", "net_liquidity_slope_4w", "liquidity_state"])


def q_macro_by_bar(s, d):
    return rounded(context.macro_by_bar(fixtures.close_of(walk_bars(s, d)), fixtures.macro(s, d)), K, ["macro_liquidity_state", "macro_net_liquidity_4w_change", "macro_status"])


def _external(s, d):
    b = walk_bars(s, d)
    return lambda x: context.external_context(x, fixtures.vix(s, d), fixtures.breadth(b), fixtures.macro(s, d), fixtures.news(s, d))


def q_external_context(s, d):
    return rounded(_external(s, d)(fixtures.close_of(walk_bars(s, d))), K, ["vix", "vix_zscore", "vix_change_5d", "breadth_sma50", "breadth_sma50_change5", "macro_liquidity_state", "macro_net_liquidity_4w_change", "macro_status", "news_count_7d", "news_scored_7d", "news_sentiment_7d", "news_quality"])


def q_context_snapshot(s, d):
    b = walk_bars(s, d)
    x = context.context_snapshot(fixtures.at("1996-07-01 21:00:00"), s, fixtures.vix(s, d), fixtures.breadth(b), features.asset_liquidity(b), fixtures.macro(s, d), fixtures.news(s, d), "ASIA")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    x = x.select(
        day("vix.observation_date").alias("vix_day"), "vix.vix", "vix.vix_change_1d", "vix.vix_change_5d", C("vix.vix_zscore_252d").alias("vix_zscore"), day(scalars.ny_time(C("breadth.timestamp"))).alias("breadth_day"),
        C("breadth.members_available").alias("members"), "breadth.breadth_sma20", "breadth.breadth_sma50", "breadth.breadth_sma200", "breadth.advances", "breadth.declines", C("asset_liquidity.bar_index").alias("asset_bar"),
        "asset_liquidity.dollar_volume", *(C("macro")[k].alias(k) for k in ("fed_assets", "tga", "rrp")), "treasury_2s10s", day("net_liquidity.observation_date").alias("net_day"), C("net_liquidity.net_liquidity").alias("net"),
        "net_liquidity.net_liquidity_4w_change", "net_liquidity.liquidity_state", C("news.count_1d").alias("news_1d"), C("news.count_7d").alias("news_7d"), C("news.scored_7d").alias("news_scored_7d"), C("news.sentiment_7d").alias("news_sentiment_7d"))
    return rounded(x.withColumnRenamed("net", "net_liquidity"), [], [c if c != "net" else "net_liquidity" for c in x.columns])


def q_latest_available(s, d):
    x = context.latest(features.asset_liquidity(walk_bars(s, d)), fixtures.at("1996-07-01 21:00:00"), ["ticker"])
    return x.select("ticker", "bar_index", F.round("dollar_volume", 4).alias("dollar_volume"))


def q_headline_score(s, d):
    return fixtures.news(s, d).select("doc_id", F.round("score", 9).alias("score"))


def q_redaction(s, d):
    t = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(F.lit("https://x.example/?id=7&API_KEY=k"), C("doc_id").cast("string"), F.lit("&token=abc next hunter2 "), C("text")).alias("t"))
    return t.select("doc_id", scalars.redact_secrets(C("t"), ("hunter2",)).alias("redacted"))


def q_common_dates(s, d):
    x = joins.common_dates(walk_bars(s, d), "ticker", "session_date")
    return x.select(*K, C("session_date").cast("string").alias("session_date"))


def q_walk_forward(s, d):
    return models.walk_forward_splits(walk_bars(s, d), 252, 21, 5, 504).drop("timeframe")


def q_registry(s, d):
    rows = [models.validated_models(s, p).select(F.lit(p).alias("purpose"), F.lit("validated").alias("kind"), "name").unionByName(models.allowed_models(s, p).select(F.lit(p), F.lit("allowed"), "name").toDF("purpose", "kind", "name")) for p in ("level", "slope_description", "volatility_forecast", "regime_description")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def q_score_returns(s, d):
    return rounded(scores.score_rows(fixtures.forecasts(s, d), "return"), ["asset", "model"], ["n", "mae", "rmse", "error_std", "directional_accuracy", "correlation"], 9)


def q_score_volatility(s, d):
    return rounded(scores.score_rows(fixtures.volatility_forecasts(s, d), "volatility"), ["asset", "model"], ["n", "mae", "rmse", "error_std", "qlike"], 7)


def q_subperiods(s, d):
    return rounded(scores.subperiod_scores(fixtures.forecasts(s, d), "return"), ["asset", "model", "subperiod"], ["n", "rmse"], 9)


def q_metrics(s, d):
    a = scores.return_metrics(fixtures.forecasts(s, d)).select("asset", "model", "n", "mae", "rmse", C("sign_agreement").alias("extra"))
    b = scores.volatility_metrics(fixtures.volatility_forecasts(s, d)).select("asset", F.concat("model", F.lit(" vol")).alias("model"), "n", "mae", "rmse", C("qlike").alias("extra"))
    return rounded(a.unionByName(b), ["asset", "model"], ["n", "mae", "rmse", "extra"], 7)


def q_cross_asset(s, d):
    return rounded(scores.cross_asset(scores.score_rows(fixtures.forecasts(s, d), "return"), "zero"), ["model"], ["mean", "median", "std", "wins", "assets"], 9)


def q_stability(s, d):
    return scores.forecast_stability(fixtures.forecasts(s, d), "zero", "return")


def q_parameter_variation(s, d):
    x = _stats(walk_bars(s, d)).where("bar_index >= 60").groupBy("ticker", F.floor(C("bar_index") / 250).alias("fold")).agg(F.avg("rolling_std_20").alias("std"), F.avg("rolling_slope_20").alias("slope"))
    long = scores.unpivot_parameters(x, ["ticker", "fold"], ["std", "slope"])
    return rounded(scores.parameter_variation(long, ("ticker",)), ["ticker", "parameter"], ["cv"])


def q_garch_filter(s, d):
    return rounded(models.garch_filter(walk_bars(s, d), 0.01, 0.05, 0.08, 0.9, 1.0), K, ["garch_vol_pct"])


def q_complexity(s, d):
    return rounded(models.rolling_complexity(_stats(walk_bars(s, d))), K, ["hurst", "shannon_entropy", "permutation_entropy"])


def q_permutation_entropy(s, d):
    x = models.rolling_complexity(_stats(walk_bars(s, d)))
    return rounded(x.withColumn("permutation_entropy", F.nanvl("permutation_entropy", F.lit(None).cast("double"))), K, ["permutation_entropy"])


def q_change_points(s, d):
    return models.rolling_change_points(_stats(walk_bars(s, d))).drop("timeframe")


def q_changepoint_robustness(s, d):
    return models.changepoint_robustness(models.changepoint_grid(_stats(walk_bars(s, d))))


def q_state_statistics(s, d):
    state = F.when(C("realized_volatility_20") > 0.02, 1).otherwise(0)
    x = _stats(walk_bars(s, d)).where("realized_volatility_20 is not null").withColumns({"state": state, "stay": F.lit(0.9)})
    return rounded(models.state_statistics(x), ["ticker", "state"], ["mean_return", "volatility", "mean_slope", "avg_duration", "observations", "trend_description", "volatility_description"])


def q_regime_changes(s, d):
    state = F.when(C("realized_volatility_20") > 0.02, 1).otherwise(0)
    x = _stats(walk_bars(s, d)).where("realized_volatility_20 is not null").withColumn("state", state)
    return models.regime_changes(x.select("ticker", "timeframe", "bar_index", "state")).drop("timeframe")


def _splits(b):
    return models.walk_forward_splits(b, 252, FOLD_STEP)


def q_fold_returns(s, d):
    b = walk_bars(s, d)
    return models.evaluate_returns(_stats(b), _splits(b))


def q_fold_volatility(s, d):
    b = walk_bars(s, d)
    return models.evaluate_volatility(_stats(b), _splits(b))


def q_fold_kalman(s, d):
    b = walk_bars(s, d)
    return models.evaluate_kalman(b, _splits(b))


def q_fold_regimes(s, d):
    b = walk_bars(s, d)
    return models.evaluate_regimes(_stats(b), models.last_folds(_splits(b)))


def q_fold_stability(s, d):
    b = walk_bars(s, d)
    k = scores.kalman_stability(models.evaluate_kalman(b, _splits(b))).select("component", "stability_score")
    r = scores.regime_stability(models.evaluate_regimes(_stats(b), models.last_folds(_splits(b)))).select("component", "stability_score")
    return k.unionByName(r).unionByName(scores.changepoint_stability(models.changepoint_robustness(models.changepoint_grid(_stats(b)))))


def q_quant_context(s, d):
    return models.quant_context(walk_bars(s, d)).drop("timeframe")


_runs: dict[tuple, engine.PatternRun] = {}
SOURCES = ("region", "nation", "supplier", "orders", "lineitem", "documents")


def _snapshot(s, d) -> tuple:
    """Names, sizes and times of the files that the engine's inputs come from."""
    out = []
    for name in SOURCES:
        path = s._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        files = path.getFileSystem(s._jsc.hadoopConfiguration())
        out += sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files.listStatus(path))
    return tuple(out)


def run_engine(s, d, quant: bool = False) -> engine.PatternRun:
    """The engine over all series. Its tables are kept for the application while the files that it read stay as they are, as many
    queries report on them."""
    key = (s.sparkContext.applicationId, d, quant)
    now = _snapshot(s, d)
    if key not in _runs or _runs[key][0] != now:
        b = walk_bars(s, d)
        week = resample.complete_bars(_weekly(s, d))
        week = week.withColumn("bar_index", F.row_number().over(joins.Window.partitionBy("ticker", "timeframe").orderBy("timestamp")) - 1)
        _runs[key] = (now, engine.run_pattern_engine(fixtures.in_sql_order(b), "1Day", fixtures.benchmark(b), {"1Week": week}, models.quant_context(b) if quant else None, _external(s, d)))
    return _runs[key][1]


def _stamp(column: str, name: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm").alias(name)


def _report(df, keys, columns, digits):
    """rounded(), with lists of names as text."""
    kinds = dict(df.dtypes)
    return rounded(df.withColumns({c: F.array_join(c, ";") for c in columns if kinds[c].startswith("array")}), keys, columns, digits)


TIMES = {"first_detected_at": "first_detected", "confirmed_at": "confirmed", "invalidated_at": "invalidated", "expired_at": "expired"}
SCORES = ["score_structure", "score_momentum", "score_volatility", "score_regime", "score_context"]
DETAILS = [
    "move_extreme", "level", "level_asof_index", "breakout_distance_atr", "relative_volume", "level_type", "level_touch_count", "breakout_index", "bars_to_failure", "volatility_context", "z_start", "trigger", "stop",
    "pivot_price", "neckline", "old_pivot_index", "pivot_index",
]


def q_evidence(s, d):
    x = run_engine(s, d).evidence
    return rounded(x, K, ["structural_state", "zscore_20", "slope_20_pct", "rv20_percentile", "nearest_support", "breakout_state", "gap_up_recent", "ratio_zscore", "vix_zscore", "w1_structural_state", "htf_structural_state"])


def _results(x):
    detail = lambda k: F.get_json_object("details", f"$.{k}").cast("string" if k in ("level_type", "volatility_context") else "double").alias(f"d_{k}")
    x = x.select("*", _stamp("timestamp", "at"), *(_stamp(c, n) for c, n in TIMES.items()), *map(detail, DETAILS)).withColumns({"required_met": C("required_conditions_met"), "required_missing": C("required_conditions_missing"), "optional_met": C("optional_conditions_met"), "notes": F.array_join("notes", ";")})
    return _report(x, [*K, "at", "pattern_name", "pattern_family", "direction"], ["score", *SCORES, "evidence_for", "evidence_against", "required_met", "required_missing", "optional_met", "notes", "state", "episode_id", "bars_active", *TIMES.values(), "subtype", *(f"d_{k}" for k in DETAILS)], 9)


def q_patterns(s, d):
    return _results(run_engine(s, d).results)


def q_patterns_with_models(s, d):
    return _results(run_engine(s, d, True).results.where("state <> 'inactive'"))


def q_episodes(s, d):
    x = run_engine(s, d).episodes()
    x = x.select("*", *(_stamp(c, n) for c, n in TIMES.items()))
    return _report(x, ["ticker", "pattern", "episode_id", "pattern_family", "direction"], ["subtype", "state", *TIMES.values(), "bars_active", "score", "reached_developing", "score_max", "score_at_detection", "key_evidence_for", "key_evidence_against", "final_evidence_for", "final_evidence_against", "regime", "volatility", "is_open", "level_asof_index"], 6)


def q_pattern_summary(s, d):
    r = run_engine(s, d)
    x = scores.describe_patterns(r.episodes(), r.results)
    scored = [f"score_max_{n}" for n in ("p25", "median", "p75")]
    x = x.drop("timeframe")
    return rounded(rounded(x, [c for c in x.columns if c not in scored], scored, 8), ["ticker", "pattern", *scored], [c for c in x.columns if c not in ("ticker", "pattern", *scored)])


def q_pattern_families(s, d):
    return scores.family_states(run_engine(s, d).episodes())


def q_score_distribution(s, d):
    x = scores.score_distribution(run_engine(s, d).episodes())
    return rounded(x, ["pattern"], [c for c in x.columns if c != "pattern"], 8)


def q_pattern_overlap(s, d):
    x = scores.pattern_overlap(run_engine(s, d).results)
    return rounded(x, ["pattern_a", "pattern_b"], [c for c in x.columns if not c.startswith("pattern_")])


def q_simultaneous(s, d):
    return scores.simultaneous_patterns(run_engine(s, d).results)


def q_validation_summary(s, d):
    x = scores.validation_summary(run_engine(s, d).episodes())
    return rounded(x, ["pattern"], [c for c in x.columns if c != "pattern"], 8)


def q_pattern_checks(s, d):
    r = run_engine(s, d)
    return engine.check_results(r.results, r.evidence, r.events).drop("timeframe")


def q_bar_contexts(s, d):
    x = engine.bar_contexts(run_engine(s, d).evidence).select(*K, "regime", "volatility", "structure_context.*", "mtf_context.w1_structural_state", "volatility_context.rv20_percentile", "volatility_context.atr", "volatility_context.compression_duration", "external_context.vix", "external_context.macro_liquidity_state", "external_context.news_quality")
    return rounded(x, K, ["regime", "volatility", "structural_state", "last_high", "last_low", "nearest_support", "nearest_resistance", "breakout_state", "breakout_direction", "fake_breakout_state", "w1_structural_state", "rv20_percentile", "atr", "compression_duration", "vix", "macro_liquidity_state", "news_quality"])


def q_structure_snapshot(s, d):
    b = walk_bars(s, d)
    frame, _, swings = evidence.build_evidence(b, "1Day", fixtures.benchmark(b))
    x = structure.structure_snapshot(b, frame, structure.classify_swings(swings))
    return _report(x, ["ticker", "bar_index"], [c for c in x.columns if c not in ("ticker", "timeframe", "bar_index", "timestamp")], 6)


def q_prefix_check(s, d):
    """The engine on bars up to several cuts, against the whole run: what it said must not change when bars are added."""

    def run(b):
        r = engine.run_pattern_engine(b, "1Day", fixtures.benchmark(b))
        return rounded(r.results, ["ticker", "bar_index", "pattern_name"], ["state", "episode_id", "score"])

    return engine.prefix_differences_at(run, walk_bars(s, d).drop("session_date"), (400, 900))


def q_tick_bars(s, d):
    x = resample.bars_from_ticks(ticks(s, d), 60, "1Hour")
    return rounded(x.withColumn("at", F.date_format("timestamp", "yyyy-MM-dd HH:mm")), ["ticker", "at"], ["open", "high", "low", "close", "volume"], 4)


QUERIES = {"flagship": flagship} | {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}
