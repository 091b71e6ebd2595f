"""Bitemporal context: macro vintages, net liquidity, news, and snapshots by availability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.operators.joins import asof_join, keep_last, range_join
from barograph.operators.windows import guarded, last, ratio
from barograph.sources.schemas import MACRO_SERIES

C = F.col
DAY = 86400
EXTERNAL = [
    "vix", "vix_zscore", "vix_change_5d", "vix_available_at", "breadth_sma50", "breadth_sma50_change5", "breadth_available_at", "macro_liquidity_state",
    "macro_net_liquidity_4w_change", "macro_status", "news_count_7d", "news_scored_7d", "news_sentiment_7d", "news_quality",
]


def latest(df: DataFrame, at: Column, keys: list[str] | None = None) -> DataFrame:
    """The row of the latest available_at by a moment, per key."""
    known = df.where(C("available_at") <= at)
    row = F.max_by(F.struct(*df.columns), "available_at").alias("_row")
    return (known.groupBy(*keys) if keys else known.groupBy()).agg(row).where("_row is not null").select("_row.*")


def macro_asof(observations: DataFrame, at: Column) -> DataFrame:
    """The latest vintage of each observation known at a moment, then the latest observation of each series."""
    known = observations.where(C("available_at") <= at)
    vintages = keep_last(known, ["series", "observation_date"], ["available_at"])
    return keep_last(vintages, ["series"], ["observation_date"])


def macro_liquidity_history(observations: DataFrame, asof: list[str] | None = None) -> DataFrame:
    """Weekly net liquidity in USD millions (assets - tga - rrp, on the dates that have assets) as known at each `asof` key.

    observations hold only what each key may see (available_at already checked). Missing tga or rrp stays missing: values are
    not carried forward from other dates.
    """
    keys = asof or []
    factor = reduce(lambda acc, kv: F.when(C("series") == kv[0], F.lit(kv[1][2]).cast("double")).otherwise(acc), MACRO_SERIES.items(), F.lit(None).cast("double"))
    x = keep_last(observations, [*keys, "series", "observation_date"], ["available_at"]).withColumn("_m", C("value") * factor)
    wide = x.groupBy(*keys, "observation_date").agg(*(F.max(F.when(C("series") == s, C("_m"))).alias(s) for s in ("fed_assets", "tga", "rrp")))
    w = Window.partitionBy(*(keys or [F.lit("macro")])).orderBy("observation_date")
    x = wide.where("fed_assets is not null").withColumn("net_liquidity", C("fed_assets") - C("tga") - C("rrp"))
    year = last(52, w)
    net = C("net_liquidity")
    x = x.withColumns({
        "net_liquidity_1w_change": net - F.lag(net, 1).over(w), "net_liquidity_4w_change": net - F.lag(net, 4).over(w),
        "net_liquidity_zscore_52w": ratio(net - guarded(F.avg(net), net, year, 26), guarded(F.stddev_samp(net), net, year, 26)),
    })
    change = C("net_liquidity_4w_change")
    state = F.when(change > 0, "expanding").when(change < 0, "contracting").when(change == 0, "neutral").otherwise("unknown")
    return x.withColumns({"net_liquidity_slope_4w": change / 4, "liquidity_state": state})


#: Rows of macro observations that macro_states() takes, at most: a few weekly series of some centuries in some vintages.
MOST_OBSERVATIONS = 100_000
WEEKS_BACK = 4


def macro_states(observations: DataFrame) -> DataFrame:
    """(known_at, macro_liquidity_state, macro_net_liquidity_4w_change) at every moment at which knowledge changes.

    The weeks known at a moment and the value of each (series, week) then are as-of lookups: moments of a week's first vintage
    fold into the running five latest weeks, and each of the two weeks compared looks its values up in the vintages known by
    then. The history is short by nature, which is checked.
    """
    used = observations.where(C("series").isin("fed_assets", "tga", "rrp") & C("available_at").isNotNull())
    if used.limit(MOST_OBSERVATIONS + 1).count() > MOST_OBSERVATIONS:
        raise ValueError(f"more than {MOST_OBSERVATIONS} macro observations: thin them to vintages that change a value")
    factor = reduce(lambda acc, kv: F.when(C("series") == kv[0], F.lit(kv[1][2]).cast("double")).otherwise(acc), MACRO_SERIES.items(), F.lit(None).cast("double"))
    used = used.select("series", C("observation_date").alias("_day"), "available_at", (C("value") * factor).alias("_v"))
    arrivals = used.where("series = 'fed_assets'").groupBy("_day").agg(F.min("available_at").alias("known_at"))
    arrivals = arrivals.groupBy("known_at").agg(F.sort_array(F.collect_list("_day"), False).alias("_days"))
    so_far = Window.orderBy("known_at").rowsBetween(Window.unboundedPreceding, 0)
    # Weeks mostly arrive in order, but need not: the latest five of all that have arrived.
    latest_five = F.slice(F.sort_array(F.flatten(F.collect_list(F.slice("_days", 1, WEEKS_BACK + 1)).over(so_far)), False), 1, WEEKS_BACK + 1)
    arrivals = arrivals.select("known_at", latest_five.alias("_weeks"))
    moments = used.select(C("available_at").alias("known_at")).distinct()
    known = moments.join(arrivals, "known_at", "left").withColumn("_weeks", F.last("_weeks", True).over(so_far))
    now, then = F.get("_weeks", F.lit(0)), F.get("_weeks", F.lit(WEEKS_BACK))
    asked = known.withColumn("_day", F.explode(F.array_compact(F.array(now, then)))).select("known_at", "_day", (C("_day") == now).alias("_now"))
    seen = asked.join(used, "_day").where("available_at <= known_at").groupBy("known_at", "_now", "series").agg(F.max_by("_v", F.struct("available_at", "_v")).alias("_v"))
    value = lambda name: F.max(F.when(C("series") == name, C("_v")))
    net = seen.groupBy("known_at", "_now").agg((value("fed_assets") - value("tga") - value("rrp")).alias("_net"))
    net = net.groupBy("known_at").agg(F.max(F.when(C("_now"), C("_net"))).alias("_net"), F.max(F.when(~C("_now"), C("_net"))).alias("_old"))
    change = C("_net") - C("_old")
    state = F.when(C("_weeks").isNull(), None).when(change > 0, "expanding").when(change < 0, "contracting").when(change == 0, "neutral").otherwise("unknown")
    return known.join(net, "known_at", "left").select("known_at", state.alias("macro_liquidity_state"), change.alias("macro_net_liquidity_4w_change"))


def macro_by_bar(bars: DataFrame, observations: DataFrame, close: str = "close_time") -> DataFrame:
    """bars with the liquidity state known at each close, from as-of-safe observations only, and a status."""
    safe = observations.where("asof_safe")
    any_row, any_safe = not observations.isEmpty(), not safe.isEmpty()
    x = asof_join(bars, macro_states(safe), close, "known_at", columns=["macro_liquidity_state", "macro_net_liquidity_4w_change"])
    x = x.withColumn("macro_net_liquidity_4w_change", F.nanvl("macro_net_liquidity_4w_change", F.lit(None).cast("double")))
    status = F.lit("missing") if not any_row else F.lit("excluded_not_asof_safe") if not any_safe else F.when(C("macro_liquidity_state").isNull(), "not_yet_available").otherwise("asof_safe")
    return x.withColumn("macro_status", status)


def news_by_bar(bars: DataFrame, news: DataFrame, close: str = "close_time", least: int = 3) -> DataFrame:
    """bars with counts, intensity and mean scores of the news published in the last day and week and available by then."""
    item = news.select("ticker", C("published_at").alias("_p"), C("available_at").alias("_a"), C("score").alias("_s"))
    pairs = range_join(bars.select("ticker", "timeframe", "bar_index", close), item, close, "_p", 7 * DAY, ["ticker"]).where(C("_a") <= C(close))
    day = C("_p") > C(close) - F.expr("interval 1 day")
    sums = pairs.groupBy("ticker", "timeframe", "bar_index").agg(
        F.count_if(day).alias("news_count_1d"), F.count("*").alias("news_count_7d"), F.avg(F.when(day, C("_s"))).alias("news_sentiment_1d"), F.avg("_s").alias("news_sentiment_7d"), F.count("_s").alias("news_scored_7d"))
    x = bars.join(sums, ["ticker", "timeframe", "bar_index"], "left").fillna(0, ["news_count_1d", "news_count_7d", "news_scored_7d"])
    enough = C("news_scored_7d") >= least
    return x.withColumns({"news_intensity_7d_per_day": C("news_count_7d") / 7.0, "news_quality": F.when(enough, "ok").otherwise("insufficient_coverage"), "news_sentiment_used": F.when(enough, C("news_sentiment_7d"))})


def external_context(bars: DataFrame, vix: DataFrame | None = None, breadth: DataFrame | None = None, macro: DataFrame | None = None, news: DataFrame | None = None) -> DataFrame:
    """bars (with close_time) with the 14 external columns, each as available at the close; missing families are null with a status."""
    none = lambda kind: F.lit(None).cast(kind)
    x = bars
    if vix is not None:
        v = vix.select("available_at", "vix", C("vix_zscore_252d").alias("vix_zscore"), "vix_change_5d", C("available_at").alias("vix_available_at"))
        x = asof_join(x, v, "close_time", "available_at", columns=["vix", "vix_zscore", "vix_change_5d", "vix_available_at"])
    else:
        x = x.withColumns({"vix": none("double"), "vix_zscore": none("double"), "vix_change_5d": none("double"), "vix_available_at": none("timestamp")})
    if breadth is not None:
        w = Window.partitionBy(F.lit("breadth")).orderBy("available_at")  # one row a day
        b = breadth.select("available_at", "breadth_sma50", (C("breadth_sma50") - F.lag("breadth_sma50", 5).over(w)).alias("breadth_sma50_change5"), C("available_at").alias("breadth_available_at"))
        x = asof_join(x, b, "close_time", "available_at", columns=["breadth_sma50", "breadth_sma50_change5", "breadth_available_at"])
    else:
        x = x.withColumns({"breadth_sma50": none("double"), "breadth_sma50_change5": none("double"), "breadth_available_at": none("timestamp")})
    x = macro_by_bar(x, macro) if macro is not None else x.withColumns({"macro_liquidity_state": none("string"), "macro_net_liquidity_4w_change": none("double"), "macro_status": F.lit("missing")})
    if news is None:
        return x.withColumns({"news_count_7d": none("long"), "news_scored_7d": none("long"), "news_sentiment_7d": none("double"), "news_quality": F.lit("missing")})
    x = news_by_bar(x, news).withColumn("news_sentiment_7d", C("news_sentiment_used"))
    return x.drop("news_sentiment_used", "news_count_1d", "news_sentiment_1d", "news_intensity_7d_per_day")


def context_snapshot(at: Column, spark, vix: DataFrame, breadth: DataFrame, liquidity: DataFrame, macro: DataFrame, news: DataFrame, ticker: str) -> DataFrame:
    """One row of structs: what each family says at a moment, by availability, and the 2s10s spread."""
    row = lambda df, name: latest(df, at).select(F.struct("*").alias(name))
    x = spark.range(1).select(at.alias("as_of"))
    for df, name in ((vix, "vix"), (breadth, "breadth"), (liquidity.where(C("ticker") == ticker), "asset_liquidity")):
        x = x.join(row(df, name), F.lit(True), "left")
    m = macro_asof(macro, at).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("series", "value"))).alias("macro"))
    x = x.join(m, F.lit(True), "left").withColumn("treasury_2s10s", C("macro")["treasury_10y"] - C("macro")["treasury_2y"])
    h = macro_liquidity_history(macro.where(C("available_at") <= at)).groupBy().agg(F.max_by(F.struct("observation_date", "net_liquidity", "net_liquidity_4w_change", "liquidity_state"), "observation_date").alias("net_liquidity"))
    n = news.where((C("ticker") == ticker) & (C("published_at") <= at) & (C("available_at") <= at) & (C("published_at") > at - F.expr("interval 7 days")))
    day = C("published_at") > at - F.expr("interval 1 day")
    n = n.groupBy().agg(F.struct(F.count_if(day).alias("count_1d"), F.count("*").alias("count_7d"), (F.count("*") / 7.0).alias("per_day"), F.avg(F.when(day, C("score"))).alias("sentiment_1d"), F.avg("score").alias("sentiment_7d"), F.count("score").alias("scored_7d")).alias("news"))
    return x.join(h, F.lit(True), "left").join(n, F.lit(True), "left")
