"""Schemas of the tables that the operators exchange (DDL strings)."""

BARS = "ticker string, timeframe string, timestamp timestamp, open double, high double, low double, close double, volume double"
RAW_BARS = "symbol string, timestamp timestamp, open double, high double, low double, close double, volume double, feed string"
INTRADAY = BARS + ", is_complete boolean"
WEEKLY = BARS + ", source_last_timestamp timestamp, source_last_session_close timestamp, is_complete boolean"
MACRO = "series string, observation_date timestamp, release_date timestamp, available_at timestamp, value double, unit string, source string, asof_safe boolean"
NEWS = "ticker string, published_at timestamp, available_at timestamp, headline string, summary string, source string, score double, scoring_method string"
VIX = "observation_date timestamp, available_at timestamp, vix double, vix_change_1d double, vix_change_5d double, vix_zscore_252d double"
FORECASTS = "asset string, model string, train_start timestamp, train_end timestamp, test_date timestamp, forecast double, actual double, error double, parameter string"
EVENTS = (
    "ticker string, timeframe string, bar_index int, timestamp timestamp, level double, level_type string, level_touch_count int, level_asof_index int, "
    "direction string, state string, distance_atr double, relative_volume double, outside_bars int, retest boolean, failure_bars int, breakout_amplitude double, confidence double"
)

#: Series of the macro registry: source id, unit, factor to USD millions (null: not an amount). Fixed values.
MACRO_SERIES = {
    "fed_assets": ("WALCL", "USD millions", 1.0),
    "reserve_balances": ("WRESBAL", "USD millions", 1.0),
    "tga": ("WDTGAL", "USD millions", 1.0),
    "rrp": ("RRPONTSYD", "USD billions", 1000.0),
    "sofr": ("SOFR", "percent", None),
    "treasury_2y": ("DGS2", "percent", None),
    "treasury_10y": ("DGS10", "percent", None),
    "credit_spread": ("BAMLH0A0HYM2", "percentage points", None),
}
