"""Forecast, stability and pattern statistics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.functions.scalars import bounded
from barograph.operators.windows import ratio

C = F.col
EPS = 1e-8


def qlike(variance: Column) -> Column:
    return F.avg(F.log(variance) + C("actual") * C("actual") / variance)


def correlation(a: str, b: str) -> Column:
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def score_rows(rows: DataFrame, kind: str, keys: tuple[str, ...] = ("asset", "model")) -> DataFrame:
    """n, mae, rmse, error_std per (asset, model), and direction and correlation (returns) or QLIKE (volatility).

    Zero forecasts have no direction; a constant forecast has no correlation.
    """
    x = rows.where("forecast is not null and actual is not null").withColumn("_e", C("forecast") - C("actual"))
    out = [F.count("*").alias("n"), F.avg(F.abs("_e")).alias("mae"), F.sqrt(F.avg(C("_e") * C("_e"))).alias("rmse"), F.stddev_samp("_e").alias("error_std")]
    if kind == "return":
        hit = (F.signum("forecast") == F.signum("actual")).cast("double")
        out += [F.avg(F.when(C("forecast") != 0, hit)).alias("directional_accuracy"), F.when(F.count_distinct("forecast") > 1, correlation("forecast", "actual")).alias("correlation")]
    else:
        floor = F.greatest("forecast", F.lit(EPS))
        out.append(qlike(floor * floor).alias("qlike"))
    return x.groupBy(*keys).agg(*out)


def subperiod_scores(rows: DataFrame, kind: str) -> DataFrame:
    """score_rows() of the early and the late half of each asset's test dates; the middle date is late."""
    dates = rows.select("asset", "test_date").distinct()
    w = Window.partitionBy("asset")
    dates = dates.withColumn("subperiod", F.when(F.row_number().over(w.orderBy("test_date")) - 1 < F.floor(F.count("*").over(w) / 2), "early").otherwise("late"))
    return score_rows(rows.join(dates, ["asset", "test_date"]), kind, ("asset", "model", "subperiod"))


def volatility_metrics(rows: DataFrame) -> DataFrame:
    """Metrics of positive volatility forecasts of non-negative actuals."""
    x = rows.where("forecast > 0 and actual >= 0").withColumn("_e", C("forecast") - C("actual"))
    return x.groupBy("asset", "model").agg(F.count("*").alias("n"), F.avg(F.abs("_e")).alias("mae"), F.sqrt(F.avg(C("_e") * C("_e"))).alias("rmse"), qlike(F.greatest(C("forecast") * C("forecast"), F.lit(1e-12))).alias("qlike"))


def return_metrics(rows: DataFrame) -> DataFrame:
    """Here a zero forecast of a zero return counts as right."""
    x = rows.where("forecast is not null and actual is not null").withColumn("_e", C("forecast") - C("actual"))
    return x.groupBy("asset", "model").agg(F.count("*").alias("n"), F.avg(F.abs("_e")).alias("mae"), F.sqrt(F.avg(C("_e") * C("_e"))).alias("rmse"), F.avg((F.signum("forecast") == F.signum("actual")).cast("double")).alias("sign_agreement"))


def cross_asset(scores: DataFrame, baseline: str, metric: str = "rmse") -> DataFrame:
    """Mean, median and deviation over assets per model, and the assets where it beats the baseline."""
    base = scores.where(C("model") == baseline).select("asset", C(metric).alias("_base"))
    x = scores.join(base, "asset", "left")
    return x.groupBy("model").agg(F.avg(metric).alias("mean"), F.percentile(metric, F.lit(0.5)).alias("median"), F.stddev_samp(metric).alias("std"), F.count_if(C(metric) < C("_base")).alias("wins"), F.count(metric).alias("assets"))


def parameter_variation(parameters: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Coefficient of variation of each (keys, parameter)."""
    return parameters.groupBy(*keys, "parameter").agg((F.stddev_samp("value") / F.greatest(F.abs(F.avg("value")), F.lit(EPS))).alias("cv"))


def unpivot_parameters(wide: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return wide.unpivot(ids, values, "parameter", "value").where("value is not null")


def forecast_stability(rows: DataFrame, baseline: str, kind: str, parameters: DataFrame | None = None) -> DataFrame:
    """Stability score per model: the mean of convergence, parameter stability, fold and asset consistency, and advantage."""
    rmse = score_rows(rows, kind).select("asset", "model", "rmse")
    base = rmse.where(C("model") == baseline).select("asset", C("rmse").alias("_base"))
    by_asset = rmse.join(base, "asset", "left").groupBy("model").agg(bounded(F.avg((C("rmse") < C("_base")).cast("double"))).alias("asset_consistency"), F.avg("rmse").alias("_mean"), F.avg("_base").alias("_base_mean"))
    expected = rows.select("asset", "test_date").distinct().groupBy().agg(F.count("*").alias("_expected"))
    counts = rows.groupBy("model").agg(F.count("*").alias("_n")).join(F.broadcast(expected))
    other = rows.where(C("model") == baseline).groupBy("asset", "test_date").agg(F.avg("error").alias("_be"))
    folds = rows.groupBy("model", "asset", "test_date").agg(F.avg("error").alias("_e")).join(other, ["asset", "test_date"]).where("_e is not null and _be is not null")
    folds = folds.groupBy("model").agg(bounded(F.avg((F.abs("_e") < F.abs("_be")).cast("double"))).alias("fold_consistency"))
    lag = F.expr("try_cast(parameter as double)")
    auto = rows.where("model = 'AutoReg'").groupBy("model").agg(bounded(1 / (1 + F.stddev_samp(lag) / F.greatest(F.avg(lag), F.lit(1.0)))).alias("_s"))
    arima = rows.where("model = 'ARIMA' and parameter is not null").groupBy("model", "parameter").count().groupBy("model").agg(bounded(F.max("count") / F.sum("count")).alias("_s"))
    stable = auto.unionByName(arima)
    if parameters is not None:
        cv = parameter_variation(parameters, ("model", "asset")).groupBy("model").agg(bounded(1 / (1 + F.percentile("cv", F.lit(0.5)))).alias("_p"))
        stable = stable.join(cv, "model", "full_outer").select("model", F.coalesce("_p", "_s").alias("_s"))
    own = C("model") == baseline
    half = F.lit(0.5)
    x = counts.join(by_asset, "model").join(folds, "model", "left").join(stable, "model", "left")
    x = x.select(
        C("model").alias("component"), bounded(C("_n") / C("_expected")).alias("convergence"), F.when(own, 1.0).otherwise(F.coalesce("_s", F.lit(1.0))).alias("parameter_stability"),
        F.when(own, half).otherwise(F.coalesce("fold_consistency", F.lit(0.0))).alias("fold_consistency"), F.when(own, half).otherwise(C("asset_consistency")).alias("asset_consistency"),
        F.when(own, half).otherwise(bounded((C("_base_mean") - C("_mean")) / F.greatest("_base_mean", F.lit(1e-12)) * 10)).alias("advantage"))
    parts = ["convergence", "parameter_stability", "fold_consistency", "asset_consistency", "advantage"]
    return x.select(
        "component", F.round(sum(C(p) for p in parts) / 5, 3).alias("stability_score"), *(F.round(p, 3).alias(p) for p in parts),
        (F.lit(baseline == "zero") & (C("component") != "zero") & (C("asset_consistency") < 0.6)).alias("benchmark_only"))


def kalman_stability(folds: DataFrame) -> DataFrame:
    """Per specification: convergence, share off the boundary, innovation quality against the other specification."""
    flag = lambda c: F.avg(C(c).cast("double"))
    x = folds.groupBy("specification").agg(flag("converged").alias("convergence"), (1 - flag("boundary")).alias("boundary_free"), F.sqrt(F.avg(C("innovation") * C("innovation"))).alias("_i"), F.sum(C("innovation") * C("innovation")).alias("_ss"), F.count("innovation").alias("_n"))
    w = Window.partitionBy(F.lit(0))  # two rows
    other = F.sqrt(ratio(F.sum("_ss").over(w) - C("_ss"), (F.sum("_n").over(w) - C("_n")).cast("double")))
    x = x.withColumn("residual_quality", bounded(other / F.greatest("_i", F.lit(EPS))))
    return x.select(F.concat(F.lit("Kalman "), "specification").alias("component"), F.round((C("convergence") + C("boundary_free") + C("residual_quality")) / 3, 3).alias("stability_score"), *(F.round(c, 3).alias(c) for c in ("convergence", "boundary_free", "residual_quality")))


def regime_stability(folds: DataFrame) -> DataFrame:
    x = folds.groupBy("model").agg(F.avg(C("converged").cast("double")).alias("convergence"), F.avg(C("stable").cast("double")).alias("fit_stability"))
    return x.select(C("model").alias("component"), F.round((C("convergence") + C("fit_stability")) / 2, 3).alias("stability_score"), F.round("convergence", 3).alias("convergence"), F.round("fit_stability", 3).alias("fit_stability"))


def changepoint_stability(clusters: DataFrame) -> DataFrame:
    share = F.round(F.avg((C("stability") == "robust").cast("double")), 3)
    return clusters.groupBy("signal").agg(share.alias("stability_score")).select(F.concat(F.lit("PELT "), "signal").alias("component"), "stability_score")


# --- patterns ---------------------------------------------------------------------------------------------------------

ACTIVE = ("candidate", "developing", "confirmed")
SERIES = ["ticker", "timeframe"]


def episode_table(results: DataFrame) -> DataFrame:
    """One row per episode: what was known at its first and its last bar. Open ones are provisional."""
    first, last = (lambda c: F.min_by(c, "bar_index")), (lambda c: F.max_by(c, "bar_index"))
    x = results.where("episode_id is not null").groupBy(*SERIES, C("pattern_name").alias("pattern"), "episode_id").agg(
        first("pattern_family").alias("pattern_family"), first("direction").alias("direction"), last("subtype").alias("subtype"), last("state").alias("state"),
        first("first_detected_at").alias("first_detected_at"), *(last(c).alias(c) for c in ("confirmed_at", "invalidated_at", "expired_at", "bars_active", "score")),
        F.bool_or(C("state") == "developing").alias("reached_developing"), F.max("score").alias("score_max"), first("score").alias("score_at_detection"),
        *(last(f"score_{c}").alias(f"score_{c}") for c in ("structure", "volatility", "regime", "context", "momentum")),
        first(F.array_join("evidence_for", ";")).alias("key_evidence_for"), first(F.array_join("evidence_against", ";")).alias("key_evidence_against"),
        last(F.array_join("evidence_for", ";")).alias("final_evidence_for"), last(F.array_join("evidence_against", ";")).alias("final_evidence_against"), last("details").alias("details"),
        *(first(c).alias(c) for c in ("regime", "volatility") if c in results.columns))
    return x.withColumns({"is_open": C("invalidated_at").isNull() & C("expired_at").isNull(), "level_asof_index": F.get_json_object("details", "$.level_asof_index").cast("int")})


def describe_patterns(episodes: DataFrame, results: DataFrame) -> DataFrame:
    """Counts, durations, transition shares and score quartiles per (series, pattern)."""
    span = results.groupBy(*SERIES).agg(F.greatest(F.floor((F.unix_timestamp(F.max("timestamp")) - F.unix_timestamp(F.min("timestamp"))) / 86400) / 365.25, F.lit(1 / 365.25)).alias("_years"))
    share = lambda cond: F.avg(cond.cast("double"))
    x = episodes.groupBy(*SERIES, "pattern").agg(
        F.count("*").alias("episodes"), F.avg("bars_active").alias("mean_bars_active"), share(C("reached_developing")).alias("reached_developing"), share(C("confirmed_at").isNotNull()).alias("confirmed"),
        share(C("state") == "invalidated").alias("invalidated"), share(C("state") == "expired").alias("expired"), share(C("is_open")).alias("still_open"),
        *(F.percentile("score_max", F.lit(q)).alias(f"score_max_{n}") for q, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))),
        F.avg(F.when(C("reached_developing"), C("confirmed_at").isNotNull().cast("double"))).alias("confirmed_given_developing"))
    return x.join(span, SERIES).withColumn("episodes_per_year", C("episodes") / C("_years")).drop("_years")


def family_states(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy("pattern_family").pivot("state", ["candidate", "developing", "confirmed", "invalidated", "expired"]).count().na.fill(0)


def score_distribution(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy("pattern").agg(F.count("*").alias("count"), F.avg("score_max").alias("mean"), F.stddev_samp("score_max").alias("std"), F.min("score_max").alias("min"), *(F.percentile("score_max", F.lit(q / 100)).alias(f"p{q}") for q in (10, 25, 50, 75, 90)), F.max("score_max").alias("max"))


def active_bars(results: DataFrame) -> DataFrame:
    return results.where(C("state").isin(*ACTIVE)).select(*SERIES, "bar_index", "pattern_name").distinct()


def pattern_overlap(results: DataFrame) -> DataFrame:
    """Bars that two patterns share, as Jaccard and shares of each; at most 14 patterns meet on a bar."""
    a = active_bars(results)
    size = a.groupBy("pattern_name").count()
    both = a.alias("a").join(a.alias("b"), [*SERIES, "bar_index"]).where("a.pattern_name < b.pattern_name").groupBy(C("a.pattern_name").alias("pattern_a"), C("b.pattern_name").alias("pattern_b")).agg(F.count("*").alias("bars_together"))
    x = both.join(size.select(C("pattern_name").alias("pattern_a"), C("count").alias("_a")), "pattern_a").join(size.select(C("pattern_name").alias("pattern_b"), C("count").alias("_b")), "pattern_b")
    x = x.withColumns({"jaccard": C("bars_together") / (C("_a") + C("_b") - C("bars_together")), "share_of_a": C("bars_together") / C("_a"), "share_of_b": C("bars_together") / C("_b")})
    return x.withColumn("potential_redundancy", (C("jaccard") >= 0.5) | (F.greatest("share_of_a", "share_of_b") >= 0.8)).drop("_a", "_b")


def simultaneous_patterns(results: DataFrame) -> DataFrame:
    return active_bars(results).groupBy(*SERIES, "bar_index").agg(F.count("*").alias("patterns")).groupBy("patterns").agg(F.count("*").alias("bars"))


def validation_summary(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy("pattern").agg(F.count("*").alias("episodes"), F.count("confirmed_at").alias("confirmed"), F.count("invalidated_at").alias("invalidated"), F.count_if(C("state") == "expired").alias("expired"), F.count_if(C("is_open")).alias("open"), F.avg("bars_active").alias("mean_bars"), F.avg("score_max").alias("mean_score_max"))
