"""Quantitative models on series: registry, walk-forward folds, fold evaluation, the causal per-bar quant context.

Folds are rows: (series, fold) is exploded first and each fold is one small grouped map, so a long series spreads over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.operators import estimators as E
from barograph.operators.features import statistical_features
from barograph.operators.structure import dealt, per_series
from barograph.operators.windows import KEYS, guarded, prior, ratio, series
from barograph.plans.evidence import QUANT, quant_types

C = F.col
#: (name, family, role, benchmark only, stable, experimental, warning, validated for). Fixed values.
REGISTRY = (
    ("autoreg", "return", "benchmark_return", True, False, False, "no_stable_edge_over_zero_return", ()),
    ("arima", "return", "benchmark_return", True, False, False, "no_stable_edge_over_zero_return", ()),
    ("garch", "volatility", "primary_volatility", False, True, False, None, ("volatility_forecast",)),
    ("egarch", "volatility", "complementary_volatility", False, True, False, None, ("volatility_forecast",)),
    ("gjr_garch", "volatility", "possibly_redundant_volatility", False, False, False, "close_to_garch_fit_failure_avgo", ()),
    ("har_rv", "volatility", "benchmark_volatility", True, False, False, None, ()),
    ("kalman_local_level", "state_space", "stable_level_state", False, True, False, None, ("level",)),
    ("kalman_local_linear_trend", "state_space", "slope_description", False, False, False, "boundary_estimates_57pct_less_stable", ("slope_description",)),
    ("hmm2", "regime", "regime_description", False, True, False, None, ("regime_description",)),
    ("markov2", "regime", "regime_description", False, True, False, None, ("regime_description",)),
    ("hmm3", "regime", "regime_description", False, False, True, "unstable_across_assets", ()),
    ("markov3", "regime", "regime_description", False, False, True, "unstable_across_assets", ()),
    ("pelt", "change_point", "retrospective_description", False, False, False, "retrospective_not_causal", ("rv20_change_points", "kalman_slope_change_points")),
    ("hurst", "complexity", "descriptive_feature", False, False, False, None, ("descriptive_feature",)),
    ("shannon_entropy", "complexity", "descriptive_feature", False, False, False, None, ("descriptive_feature",)),
    ("permutation_entropy", "complexity", "descriptive_feature", False, False, False, None, ("descriptive_feature",)),
)
REGISTRY_SCHEMA = "name string, family string, role string, benchmark_only boolean, stable_for_current_use boolean, experimental boolean, warning string, validated_for array<string>"
REGIME_INPUTS = ["log_return", "realized_volatility_20", "rolling_slope_20"]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r[:7], list(r[7])) for r in REGISTRY], REGISTRY_SCHEMA)


def allowed_models(spark: SparkSession, purpose: str) -> DataFrame:
    return registry(spark).where(F.array_contains("validated_for", purpose) & ~C("experimental"))


def validated_models(spark: SparkSession, purpose: str) -> DataFrame:
    return allowed_models(spark, purpose).where("stable_for_current_use and not benchmark_only")


def walk_forward_splits(bars: DataFrame, min_train: int = 252, step: int = 21, horizon: int = 1, window: int | None = None) -> DataFrame:
    """(series, fold, train_start, train_end exclusive, test_pos): expanding, or rolling over `window` rows."""
    if min_train < 60 or step < 1 or horizon < 1 or (window is not None and window < min_train):
        raise ValueError("need min_train >= 60, step and horizon >= 1, window >= min_train")
    n = bars.groupBy(*KEYS).agg(F.count("*").cast("int").alias("n")).where(C("n") >= min_train + horizon)
    x = n.select(*KEYS, F.posexplode(F.sequence(F.lit(min_train + horizon - 1), C("n") - 1, F.lit(step))).alias("fold", "test_pos"))
    x = x.withColumn("train_end", C("test_pos") - horizon + 1)
    start = F.greatest(F.lit(0), C("train_end") - window) if window else F.lit(0)
    return x.select(*KEYS, "fold", start.alias("train_start"), "train_end", "test_pos")


def fold_rows(features: DataFrame, splits: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that each fold may see: its training rows and the test row."""
    x = features.select(*KEYS, "bar_index", "timestamp", *columns)
    return x.join(splits, KEYS).where((C("bar_index") >= C("train_start")) & (C("bar_index") <= C("test_pos")))


def evaluate_returns(features: DataFrame, splits: DataFrame) -> DataFrame:
    """One-step return forecasts of each fold: zero, last, autoregression, ARIMA."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_index")
        y = pdf["log_return"].to_numpy(float)[1:] if np.isnan(pdf["log_return"].iloc[0]) else pdf["log_return"].to_numpy(float)
        train, actual = y[:-1], float(y[-1])
        found = [("zero", 0.0, None), ("last", float(train[-1]), None)]
        auto = E.fit_autoreg(train)
        found.append(("AutoReg", float(E.autoreg_one_step(auto["beta"], y)[-1]), str(auto["lags"])))
        arima = E.fit_arima(train)
        found.append(("ARIMA", float(E.arima_one_step(arima, y)[-1]), "-".join(map(str, arima["order"]))))
        first, last = pdf["timestamp"].iloc[0], pdf["timestamp"].iloc[-2]
        return pd.DataFrame([(pdf["ticker"].iloc[0], m, first, last, pdf["timestamp"].iloc[-1], f, actual, f - actual, p) for m, f, p in found], columns=FORECAST_COLUMNS)

    return dealt(fold_rows(features, splits, ["log_return"]), *KEYS, "fold").groupBy(*KEYS, "fold").applyInPandas(run, FORECASTS)


FORECASTS = "asset string, model string, train_start timestamp, train_end timestamp, test_date timestamp, forecast double, actual double, error double, parameter string"
FORECAST_COLUMNS = [c.split()[0] for c in FORECASTS.split(", ")]


def evaluate_volatility(features: DataFrame, splits: DataFrame) -> DataFrame:
    """One-step forecasts of 20-bar realised volatility: last, HAR, GARCH, EGARCH, GJR from 19 known squares and the variance.

    The last three choose Normal or Student-t errors by AIC; a fold where neither converges has no row of that model."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_index")
        r, rv = pdf["log_return"].to_numpy(float), pdf["realized_volatility_20"].to_numpy(float)
        known, actual = r[1:-1], float(rv[-1])
        found = [("last", float(rv[-2]), None)]
        try:
            har = E.fit_har(rv[:-1])
            found.append(("HAR-RV", max(float(E.har_rows(rv[-23:-1])[-1] @ har["beta"]), 1e-8), None))
        except ValueError:
            pass
        for name, kind in (("GARCH", "garch"), ("EGARCH", "egarch"), ("GJR-GARCH", "gjr")):
            fit = E.settled_variance(kind, known * 100)
            if fit is None:
                continue
            path = E.variance_path(kind, np.append(known * 100 - fit["mu"], 0.0), fit["params"], fit["backcast"])
            found.append((name, float(np.sqrt((known[-19:] ** 2).sum() + path[-1] / 1e4)), fit["dist"]))
        first, last = pdf["timestamp"].iloc[0], pdf["timestamp"].iloc[-2]
        return pd.DataFrame([(pdf["ticker"].iloc[0], m, first, last, pdf["timestamp"].iloc[-1], f, actual, f - actual, p) for m, f, p in found], columns=FORECAST_COLUMNS)

    return dealt(fold_rows(features, splits, ["log_return", "realized_volatility_20"]), *KEYS, "fold").groupBy(*KEYS, "fold").applyInPandas(run, FORECASTS)


def evaluate_kalman(bars: DataFrame, splits: DataFrame) -> DataFrame:
    schema = "asset string, specification string, test_date timestamp, innovation double, converged boolean, boundary boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_index")
        y, out = pdf["close"].to_numpy(float), []
        for spec in ("local level", "local linear trend"):
            fit = E.fit_state(y[:-1], spec)
            innovation = (E.filter_level if spec == "local level" else E.filter_trend)(y, *fit["params"])[-2][-1]
            out.append((pdf["ticker"].iloc[0], spec, pdf["timestamp"].iloc[-1], float(innovation), fit["converged"], fit["boundary"]))
        return pd.DataFrame(out, columns=[c.rsplit(" ", 1)[0] for c in schema.split(", ")])

    return dealt(fold_rows(bars, splits, ["close"]), *KEYS, "fold").groupBy(*KEYS, "fold").applyInPandas(run, schema)


#: Share of rows whose states must agree between starts.
STABLE = 0.8


def last_folds(splits: DataFrame) -> DataFrame:
    """The last fold of each series."""
    last = splits.groupBy(*KEYS).agg(F.max("fold").alias("fold"))
    return splits.join(last, [*KEYS, "fold"], "left_semi")


def evaluate_regimes(features: DataFrame, splits: DataFrame) -> DataFrame:
    """Per fold and model (2 and 3 states): convergence, and stability over three starts. A hidden chain on the returns and their
    volatility and slope is stable when the starts' states agree on `STABLE` of the rows; a switching model of the returns when
    it converges."""
    schema = "asset string, model string, test_date timestamp, converged boolean, stable boolean, agreement double, loglik double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_index").dropna(subset=REGIME_INPUTS)
        out = []
        for name, columns in (("hmm", REGIME_INPUTS), ("markov", ["log_return"])):
            x = pdf[columns].to_numpy(float)
            x = (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-12)
            for states in (2, 3):
                fits = [E.fit_regimes(x, states, seed) for seed in (42, 43, 44)]
                best = max(fits, key=lambda f: f["loglik"])
                labels = E.filter_regimes(best, x).argmax(axis=1)
                share = min(E.agreement(labels, E.filter_regimes(f, x).argmax(axis=1), states) for f in fits)
                out.append((pdf["ticker"].iloc[0], f"{name}{states}", pdf["timestamp"].iloc[-1], best["converged"], share >= STABLE if name == "hmm" else best["converged"], share, best["loglik"]))
        return pd.DataFrame(out, columns=[c.rsplit(" ", 1)[0] for c in schema.split(", ")])

    return dealt(fold_rows(features, splits, REGIME_INPUTS), *KEYS, "fold").groupBy(*KEYS, "fold").applyInPandas(run, schema)


def garch_filter(bars: DataFrame, mu: float, omega: float, alpha: float, beta: float, start: float) -> DataFrame:
    """Volatility of percent returns with fixed parameters: one pass over each series, each variance from the one before."""
    x = bars.withColumn("_e", (F.log("close") - F.log(F.lag("close").over(series()))) * 100 - mu).where("_e is not null")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        variance, shock, out = start, start, np.empty(len(pdf))
        for i, e in enumerate(pdf["_e"].tolist()):
            variance = omega + alpha * shock + beta * variance
            shock = e * e
            out[i] = variance
        return pd.DataFrame({"ticker": pdf["ticker"], "timeframe": pdf["timeframe"], "bar_index": pdf["bar_index"], "garch_vol_pct": np.sqrt(out)})

    return per_series(x.select(*KEYS, "bar_index", "_e"), run, "ticker string, timeframe string, bar_index int, garch_vol_pct double")


def rolling_complexity(features: DataFrame, window: int = 100, bins: int = 10, order: int = 3) -> DataFrame:
    """(series, bar_index, hurst, shannon_entropy, permutation_entropy) of the last `window` returns."""
    if window < 32 or bins < 2 or order < 2 or order > window:
        raise ValueError("complexity parameters")
    schema = "ticker string, timeframe string, bar_index int, hurst double, shannon_entropy double, permutation_entropy double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf["log_return"].to_numpy(float)
        out = np.full((len(r), 3), np.nan)
        for i in range(window - 1, len(r)):
            v = r[i - window + 1 : i + 1]
            if not np.isnan(v).any():
                out[i] = E.hurst(v), E.shannon_entropy(v, bins), E.permutation_entropy(v, order)
        return pd.DataFrame({"ticker": pdf["ticker"], "timeframe": pdf["timeframe"], "bar_index": pdf["bar_index"], "hurst": out[:, 0], "shannon_entropy": out[:, 1], "permutation_entropy": out[:, 2]})

    return per_series(features.select(*KEYS, "bar_index", "log_return"), run, schema)


def rolling_change_points(features: DataFrame, window: int = 120, min_size: int = 10, penalty: float = 3.0, recent: int = 15) -> DataFrame:
    """Age of the last change point of volatility and slope in each trailing window, and whether it is recent."""
    schema = "ticker string, timeframe string, bar_index int, cp_rv20_recent boolean, cp_rv20_age double, cp_slope_recent boolean, cp_slope_age double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"ticker": pdf["ticker"], "timeframe": pdf["timeframe"], "bar_index": pdf["bar_index"]}
        for name, column in (("rv20", "realized_volatility_20"), ("slope", "rolling_slope_20")):
            v = pdf[column].to_numpy(float)
            flag, age = [None] * len(v), np.full(len(v), np.nan)
            for i in range(window - 1, len(v)):
                part = v[i - window + 1 : i + 1]
                if np.isnan(part).any():
                    continue
                points = E.change_points(part, penalty, min_size)
                flag[i] = False
                if points:
                    age[i] = window - 1 - points[-1]
                    flag[i] = bool(age[i] <= recent)
            out |= {f"cp_{name}_recent": pd.array(flag, dtype="boolean"), f"cp_{name}_age": age}
        return pd.DataFrame(out)

    return per_series(features.select(*KEYS, "bar_index", "realized_volatility_20", "rolling_slope_20"), run, schema)


def refit_positions(features: DataFrame, min_train: int = 252, every: int = 63) -> DataFrame:
    """(series, fit_index, last_index): refits from the first bar with min_train valid rows on, each for the bars until the next."""
    valid = sum(C(c).isNotNull().cast("int") for c in REGIME_INPUTS) == len(REGIME_INPUTS)
    w = series().rowsBetween(-(2**31), 0)
    x = features.withColumns({"_v": valid, "_n": F.sum(valid.cast("int")).over(w)})
    x = x.groupBy(*KEYS).agg(F.min(F.when(C("_v") & (C("_n") >= min_train), C("bar_index"))).alias("_first"), F.max("bar_index").alias("_end")).where("_first is not null")
    x = x.withColumn("fit_index", F.explode(F.sequence("_first", "_end", F.lit(every))))
    return x.select(*KEYS, C("fit_index").cast("int"), F.least(C("fit_index") + every - 1, C("_end")).cast("int").alias("last_index"))


def quant_context(bars: DataFrame, min_train: int = 252, every: int = 63, lag: int = 5, steps: int = 40) -> DataFrame:
    """(series, bar_index and the 16 quant columns): each bar's values come from the last fit at or before it, filtered only.

    A fit that fails leaves nulls. Lagged values come from the same fit.
    """
    features = statistical_features(bars)
    fits = refit_positions(features, min_train, every)
    rows = features.select(*KEYS, "bar_index", "close", *REGIME_INPUTS).join(fits, KEYS).where(C("bar_index") <= C("last_index"))
    schema = "ticker string, timeframe string, bar_index int, quant_fit_index int, hmm_p_high double, hmm_p_high_lag double, markov_p_high double, markov_p_high_lag double, kalman_level double, kalman_level_change double, kalman_level_change_lag double, garch_vol double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_index").reset_index(drop=True)
        fit_at, n = int(pdf["fit_index"].iloc[0]), len(pdf)
        index = pdf["bar_index"].to_numpy()
        train = int(np.searchsorted(index, fit_at)) + 1
        shift = lambda v: np.concatenate([np.full(min(lag, n), np.nan), v[: max(n - lag, 0)]])
        out = {}
        x = pdf[REGIME_INPUTS].to_numpy(float)
        ok = ~np.isnan(x).any(axis=1)
        for name, columns in (("hmm", [0, 1, 2]), ("markov", [0])):
            p = np.full(n, np.nan)
            try:
                z = x[:, columns]
                valid = ok if name == "hmm" else ~np.isnan(z).any(axis=1)
                inside = valid & (np.arange(n) < train)
                z = (z - z[inside].mean(axis=0)) / np.maximum(z[inside].std(axis=0), 1e-12)
                fit = max((E.fit_regimes(z[inside], 2, seed, steps) for seed in (42, 43)), key=lambda f: f["loglik"])
                q = E.filter_regimes(fit, z[valid])
                states, vol = q[: int(inside.sum())].argmax(axis=1), x[inside][:, 1]
                means = [np.nanmean(vol[states == s]) if (states == s).any() and not np.isnan(vol[states == s]).all() else -np.inf for s in (0, 1)]
                p[valid] = q[:, int(np.argmax(means))]
            except (np.linalg.LinAlgError, ValueError, FloatingPointError):
                pass
            out |= {f"{name}_p_high": p, f"{name}_p_high_lag": shift(p)}
        y = pdf["close"].to_numpy(float)
        level = E.filter_level(y, *E.fit_state(y[:train])["params"])[0]
        change = level - shift(level)
        out |= {"kalman_level": level, "kalman_level_change": change, "kalman_level_change_lag": shift(change)}
        r = x[1:, 0] * 100
        fit = E.best_variance("garch", r[: train - 1])
        out["garch_vol"] = np.concatenate([[np.nan], np.sqrt(E.variance_path("garch", r - fit["mu"], fit["params"], fit["backcast"])) / 100])
        done = pd.DataFrame({"ticker": pdf["ticker"], "timeframe": pdf["timeframe"], "bar_index": index, "quant_fit_index": fit_at, **out})
        return done[index >= fit_at]

    fitted = dealt(rows, *KEYS, "fit_index").groupBy(*KEYS, "fit_index").applyInPandas(run, schema)
    x = bars.select(*KEYS, "bar_index").join(fitted, [*KEYS, "bar_index"], "left")
    clean = {c: F.nanvl(c, F.lit(None).cast("double")) for c, t in quant_types().items() if t == "double" and c in fitted.columns}
    x = x.withColumns(clean)
    x = x.withColumn("garch_vol_ratio", ratio(C("garch_vol"), guarded(F.percentile("garch_vol", F.lit(0.5)), C("garch_vol"), prior(60), 20)))
    x = x.join(rolling_change_points(features), [*KEYS, "bar_index"], "left").join(rolling_complexity(features).drop("shannon_entropy"), [*KEYS, "bar_index"], "left")
    return x.select(*KEYS, "bar_index", *(F.nanvl(c, F.lit(None).cast("double")).alias(c) if quant_types()[c] == "double" else C(c) for c in QUANT))


def regime_changes(states: DataFrame) -> DataFrame:
    """Rows (series, bar_index, state) whose state differs from the one before; the first row is none."""
    w = series()
    return states.withColumn("_before", F.lag("state").over(w)).where(C("_before").isNotNull() & (C("state") != C("_before"))).drop("_before")


def state_statistics(rows: DataFrame, stay: str = "stay") -> DataFrame:
    """Per (series, state): mean return, volatility and slope, average duration 1 / (1 - stay), and descriptions.

    rows: log_return, realized_volatility_20, rolling_slope_20, state, and the state's probability of staying.
    """
    from pyspark.sql.window import Window

    x = rows.groupBy(*KEYS, "state").agg(F.avg("log_return").alias("mean_return"), F.avg("realized_volatility_20").alias("volatility"), F.avg("rolling_slope_20").alias("mean_slope"), F.first(stay).alias("_stay"), F.count("*").alias("observations"))
    w = Window.partitionBy(*KEYS)
    tolerance = F.greatest(F.stddev_pop("mean_return").over(w) * 0.25, F.lit(1e-5))
    place, n = F.row_number().over(w.orderBy("volatility", "state")), F.count("*").over(w)
    return x.withColumns({
        "avg_duration": 1 / F.greatest(1 - C("_stay"), F.lit(1e-8)),
        "trend_description": F.when(C("mean_return") > tolerance, "positive").when(C("mean_return") < -tolerance, "negative").otherwise("neutral"),
        "volatility_description": F.when(place == 1, "low").when((place == n), "high").otherwise("middle"),
    }).drop("_stay")


def diagnostics(features: DataFrame, lags: int = 10) -> DataFrame:
    """Full-sample tests per series: Jarque-Bera and Ljung-Box of returns natively, augmented Dickey-Fuller of closes."""
    from pyspark.sql.window import Window

    w = series()
    r = features.where("log_return is not null").withColumn("_d", C("log_return") - F.avg("log_return").over(Window.partitionBy(*KEYS)))
    x = r.withColumns({f"_l{k}": F.lag("_d", k).over(w) for k in range(1, lags + 1)})
    x = x.groupBy(*KEYS).agg(F.count("*").alias("nobs"), F.sum(C("_d") * C("_d")).alias("_v"), F.skewness("_d").alias("_s"), F.kurtosis("_d").alias("_k"), *(F.sum(C("_d") * C(f"_l{k}")).alias(f"_c{k}") for k in range(1, lags + 1)))
    n = C("nobs")
    box = n * (n + 2) * sum(((C(f"_c{k}") / C("_v")) * (C(f"_c{k}") / C("_v")) / (n - k) for k in range(1, lags + 1)), F.lit(0.0))
    tests = x.select(*KEYS, "nobs", (n / 6 * (C("_s") * C("_s") + C("_k") * C("_k") / 4)).alias("jarque_bera"), box.alias("ljung_box"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, k, rows = E.adf(pdf["close"].to_numpy(float))
        return pd.DataFrame({"ticker": pdf["ticker"].iloc[:1], "timeframe": pdf["timeframe"].iloc[:1], "adf": t, "adf_lags": k, "adf_nobs": rows})

    return tests.join(per_series(features.select(*KEYS, "bar_index", "close"), run, "ticker string, timeframe string, adf double, adf_lags int, adf_nobs int"), KEYS)


def changepoint_robustness(points: DataFrame, settings: int = 9, gap_days: int = 8, least: int = 5) -> DataFrame:
    """Clusters of change dates (ticker, signal, setting, date) at most gap_days apart; robust if enough settings agree."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("ticker", "signal").orderBy("date", "setting")
    x = points.withColumn("_new", F.coalesce((F.datediff("date", F.lag("date").over(w)) > gap_days).cast("int"), F.lit(1)))
    x = x.withColumn("cluster", F.sum("_new").over(w))
    x = x.groupBy("ticker", "signal", "cluster").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_distinct("setting").alias("settings"))
    return x.withColumn("stability", F.when(C("settings") >= least, "robust").otherwise("sensitive"))


def changepoint_grid(features: DataFrame, penalties: tuple[float, ...] = (2.0, 3.0, 5.0), sizes: tuple[int, ...] = (10, 20, 30)) -> DataFrame:
    """(ticker, signal, setting, date): change dates of returns, volatility and the filtered slope of a local linear trend under a
    grid of settings. The trend is fitted on the whole series: a description of the past, not for use at earlier bars."""
    schema = "ticker string, signal string, setting string, date date"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.assign(_trend=np.nan)
        y = pdf["close"].to_numpy(float)
        if len(y) > 3:
            pdf["_trend"] = E.filter_trend(y, *E.fit_state(y, "local linear trend")["params"])[1]
        for signal, column in (("returns", "log_return"), ("rv20", "realized_volatility_20"), ("kalman_slope", "_trend")):
            part = pdf.dropna(subset=[column])
            for p in penalties:
                for size in sizes:
                    out += [(pdf["ticker"].iloc[0], signal, f"{p}/{size}", pd.Timestamp(part["timestamp"].iloc[i]).date()) for i in E.change_points(part[column].to_numpy(float), p, size)]
        return pd.DataFrame(out, columns=["ticker", "signal", "setting", "date"])

    return per_series(features.select(*KEYS, "bar_index", "timestamp", "close", "log_return", "realized_volatility_20"), run, schema)
