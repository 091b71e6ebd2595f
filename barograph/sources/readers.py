"""Sources: bar files with feed selection, macro, VIX, news and forecast files, and the bars derived from the TPC-H-like tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.functions.scalars import headline_score
from barograph.sources import schemas

NY = "America/New_York"
FEEDS = ("iex", "sip", "otc", "boats", "overnight", "delayed_sip")
RAW_TIMEFRAMES = ("15Min", "1Hour", "1Day", "1Week")
TIMEFRAMES = ("15Min", "1Hour", "4Hour", "1Day", "1Week")
SESSIONS = ("regular", "extended")
KEYS = ["ticker", "timeframe"]


def data_feed(value: str | None = None, variable: str = "BAROGRAPH_DATA_FEED") -> str:
    """An explicit feed, else the environment's, else iex; unknown feeds are refused."""
    feed = (value or os.environ.get(variable) or "iex").strip().lower()
    if feed not in FEEDS:
        raise ValueError(f"unknown feed {feed!r}")
    return feed


def check_request(timeframe: str, session: str) -> None:
    if timeframe not in TIMEFRAMES or session not in SESSIONS:
        raise ValueError(f"unsupported timeframe {timeframe!r} or session {session!r}")
    if timeframe in ("1Day", "1Week") and session != "regular":
        raise ValueError("1Day and 1Week have only the regular session")


def source_timeframe(timeframe: str, session: str = "regular") -> str:
    """The stored timeframe that a requested one is built from."""
    check_request(timeframe, session)
    if timeframe == "1Week":
        return "1Day"
    if session == "regular" and timeframe in ("1Hour", "4Hour"):
        return "15Min"
    return "1Hour" if timeframe == "4Hour" else timeframe


def numbered(bars: DataFrame) -> DataFrame:
    """Adds bar_index, 0-based in timestamp order within (ticker, timeframe)."""
    return bars.withColumn("bar_index", F.row_number().over(Window.partitionBy(*KEYS).orderBy("timestamp")) - 1)


def raw_bars(spark: SparkSession, path: str, symbol: str, timeframe: str, start: str, end: str, feed: str | None = None) -> DataFrame:
    """Stored bars of one symbol (upper-cased), start and end inclusive. The filters reach the Parquet scan."""
    if timeframe not in RAW_TIMEFRAMES:
        raise ValueError(f"no raw timeframe {timeframe!r}")
    bars = spark.read.schema(schemas.RAW_BARS + ", timeframe string").parquet(path)
    within = F.col("timestamp").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return bars.where((F.col("symbol") == symbol.upper()) & (F.col("timeframe") == timeframe) & (F.col("feed") == data_feed(feed)) & within)


def normalized_frame(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Bars in [start, end) as the BARS schema. Naive bounds are UTC (the session's zone); start must precede end."""
    first, last = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    ok = raw.sparkSession.range(1).select((first < last).alias("ok")).first()["ok"]
    if not ok:
        raise ValueError("start must be before end")
    kept = raw.where((F.col("timestamp") >= first) & (F.col("timestamp") < last))
    name = "symbol" if "symbol" in raw.columns else "ticker"
    return kept.select(F.col(name).alias("ticker"), "timeframe", "timestamp", *(F.col(c).cast("double") for c in ("open", "high", "low", "close", "volume")))


def macro_vintages(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Vintage observations from JSON lines (date, realtime_start, value): available one day after the release date."""
    source, unit, _ = schemas.MACRO_SERIES[name]
    rows = spark.read.schema("date string, realtime_start string, value string").json(path)
    release = F.col("realtime_start").cast("timestamp")
    rows = rows.select(
        F.lit(name).alias("series"), F.col("date").cast("timestamp").alias("observation_date"), release.alias("release_date"),
        (release + F.expr("interval 1 day")).alias("available_at"), F.expr("try_cast(value as double)").alias("value"),
        F.lit(unit).alias("unit"), F.lit(source).alias("source"), F.lit(True).alias("asof_safe"))
    return rows.where("value is not null and not isnan(value)")


def macro_revisions(spark: SparkSession, path: str, name: str, fetched: str) -> DataFrame:
    """Current revisions from CSV (date, value): available when fetched, not safe for as-of use."""
    source, unit, _ = schemas.MACRO_SERIES[name]
    rows = spark.read.option("header", True).schema("date string, value string").csv(path)
    rows = rows.select(
        F.lit(name).alias("series"), F.col("date").cast("timestamp").alias("observation_date"), F.lit(None).cast("timestamp").alias("release_date"),
        F.lit(fetched).cast("timestamp").alias("available_at"), F.expr("try_cast(value as double)").alias("value"),
        F.lit(unit).alias("unit"), F.lit(source).alias("source"), F.lit(False).alias("asof_safe"))
    return rows.where("value is not null and not isnan(value)")


def vix_closes(spark: SparkSession, path: str) -> DataFrame:
    """(observation_date, vix) from a CSV whose header has a date column and `close` or `vix close`, in any case and spacing. Of
    rows that repeat a date the greatest close counts, whatever their order."""
    rows = spark.read.option("header", True).csv(path)
    names = {c.strip().lower(): c for c in rows.columns}
    close = names.get("close", names.get("vix close"))
    if close is None:
        raise ValueError(f"no VIX close among {rows.columns}")
    date = names.get("date", rows.columns[0])
    day = F.coalesce(F.expr(f"try_to_timestamp(`{date}`, 'MM/dd/yyyy')"), F.expr(f"try_cast(`{date}` as timestamp)"))
    rows = rows.select(day.alias("observation_date"), F.expr(f"try_cast(`{close}` as double)").alias("vix")).dropna()
    return rows.groupBy("observation_date").agg(F.max("vix").alias("vix"))


def news(spark: SparkSession, path: str) -> DataFrame:
    """News from JSON lines (ticker, headline, summary, source, created_at, updated_at), available when last touched, scored."""
    rows = spark.read.schema("ticker string, headline string, summary string, source string, created_at timestamp, updated_at timestamp").json(path)
    return rows.select(
        "ticker", F.col("created_at").alias("published_at"), F.greatest("created_at", "updated_at").alias("available_at"), "headline", "summary", "source",
        headline_score(F.col("headline")).alias("score"), F.lit("fixed_english_headline_lexicon_v1").alias("scoring_method"))


def forecasts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(schemas.FORECASTS).csv(path)


# --- bars derived from the TPC-H-like tables --------------------------------------------------------------------------


def walk_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per region in integer cents: BARS columns, session_date and bar_index."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    geo = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("ticker"))
    days = read("lineitem").join(geo, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("ticker", F.col("l_shipdate").cast("date").alias("session_date")).agg(
        F.sum("l_partkey").alias("sp"), F.sum(F.col("l_suppkey") * 31 + F.col("l_orderkey")).alias("sk"), F.sum("l_quantity").cast("long").alias("volume"))
    w = Window.partitionBy("ticker").orderBy("session_date")
    p = days.withColumn("close_c", 20000 + F.sum(F.col("sp") % 201 - 100).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumn("open_c", F.coalesce(F.lag("close_c").over(w), F.lit(20000)) + F.col("sk") % 61 - 30)
    cents = {"open": F.col("open_c"), "high": F.greatest("open_c", "close_c") + F.col("sp") % 47, "low": F.least("open_c", "close_c") - F.col("sk") % 43, "close": F.col("close_c")}
    return p.select(
        "ticker", F.lit("1Day").alias("timeframe"), F.to_utc_timestamp(F.col("session_date").cast("timestamp"), NY).alias("timestamp"),
        *((c.cast("double") / 100.0).alias(n) for n, c in cents.items()), F.col("volume").cast("double").alias("volume"),
        "session_date", (F.row_number().over(w) - 1).alias("bar_index"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks from events: ticker = event type, price = value."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").cast("double").alias("price"))
