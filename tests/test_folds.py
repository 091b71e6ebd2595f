import datetime as dt

import numpy as np
import pytest

from barograph.operators import estimators as E
from barograph.operators import models
from barograph.plans import registry


def test_folds_step_as_in_the_reference(spark):
    bars = spark.range(2499).selectExpr("'A' as ticker", "'1Day' as timeframe", "id")
    got = sorted(r.test_pos for r in registry._splits(bars).collect())
    assert got == list(range(252, 2499, 63)) and len(got) == 36


def test_arima_uses_the_whole_training_slice(spark):
    rng = np.random.default_rng(5)
    e = rng.normal(0, 0.01, 903)
    y = np.concatenate([e[2:402] + 0.5 * e[1:401] + 0.4 * e[:400], e[402:902] - 0.3 * e[401:901]])
    assert E.fit_arima(y[:400])["order"][2] == 2 and len(E.ORDERS) == 18
    start = dt.datetime(2020, 1, 1)
    rows = [("A", "1Day", i, start + dt.timedelta(days=i), None if i == 0 else float(y[i - 1])) for i in range(901)]
    features = spark.createDataFrame(rows, "ticker string, timeframe string, bar_index int, timestamp timestamp, log_return double")
    splits = spark.createDataFrame([("A", "1Day", 0, 0, 900, 900)], "ticker string, timeframe string, fold int, train_start int, train_end int, test_pos int")
    got = {r.model: r for r in models.evaluate_returns(features, splits).collect()}["ARIMA"]
    fit = E.fit_arima(y[:-1])
    assert got.forecast == pytest.approx(E.arima_one_step(fit, y)[-1]) and got.parameter == "-".join(map(str, fit["order"]))


def test_arima_reaches_all_stationary_parameters():
    rng, y = np.random.default_rng(2), [0.0, 0.0]
    for v in rng.normal(0, 1, 1500):
        y.append(1.2 * y[-1] - 0.5 * y[-2] + v)
    fit = E.fit_arima(np.array(y), ((2, 0, 0),))
    assert fit["params"][1:] == pytest.approx([1.2, -0.5], abs=0.08)


def test_variance_models_choose_their_errors(spark):
    r = np.random.default_rng(4).standard_t(3, 420) * 0.01
    start = dt.datetime(2020, 1, 1)
    rv = lambda i: float(np.sqrt((r[i - 20 : i] ** 2).sum())) if i >= 20 else None
    rows = [("A", "1Day", i, start + dt.timedelta(days=i), None if i == 0 else float(r[i - 1]), rv(i)) for i in range(421)]
    features = spark.createDataFrame(rows, "ticker string, timeframe string, bar_index int, timestamp timestamp, log_return double, realized_volatility_20 double")
    splits = spark.createDataFrame([("A", "1Day", 0, 0, 420, 420)], "ticker string, timeframe string, fold int, train_start int, train_end int, test_pos int")
    got = {r.model: r.parameter for r in models.evaluate_volatility(features, splits).collect()}
    assert (got["GARCH"], got["EGARCH"], got["GJR-GARCH"]) == ("t", "t", "t")
    assert E.settled_variance("garch", r[:300] * 100, most=1) is None
