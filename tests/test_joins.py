import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barograph.operators import features, joins
from barograph.plans import engine
from barograph.sources import readers, sinks

START = dt.datetime(2024, 1, 1)


def moments(rng, n, days):
    return [START + dt.timedelta(seconds=rng.randrange(days * 86400)) for _ in range(n)]


@pytest.mark.parametrize("bucket", [86400, 3600, 10**9])
def test_asof_without_keys(spark, monkeypatch, bucket):
    """Across buckets with and without right rows, equal times, and moments before everything."""
    monkeypatch.setattr(joins, "BUCKET_SECONDS", bucket)
    rng = random.Random(bucket)
    left = [(i, t) for i, t in enumerate(moments(rng, 80, 40))] + [(900, None), (901, START - dt.timedelta(days=9)), (902, START + dt.timedelta(days=90))]
    right = [(t, rng.randrange(100)) for t in moments(rng, 12, 30)]
    right += [(left[3][1], 7), (left[3][1], 70), (None, 5)]
    l, r = spark.createDataFrame(left, "id int, t timestamp"), spark.createDataFrame(right, "s timestamp, v int")
    got = {x.id: x.v for x in joins.asof_join(l, r, "t", "s", columns=["v"]).collect()}
    known = [(s, v) for s, v in right if s is not None]
    assert got == {i: max(((s, v) for s, v in known if t is not None and s <= t), default=(None, None))[1] for i, t in left}
    assert {x.v for x in joins.asof_join(l, r.limit(0), "t", "s", columns=["v"]).collect()} == {None}
    assert joins.asof_join(l.limit(0), r, "t", "s", columns=["v"]).count() == 0


def test_benchmarks_that_repeat_are_refused(spark):
    bars = spark.range(30).select(F.lit("A").alias("ticker"), F.lit("1Day").alias("timeframe"), F.timestamp_seconds(F.col("id") * 86400).alias("timestamp"), F.col("id").cast("int").alias("bar_index"), (F.col("id") + 1.0).alias("close"))
    mark = bars.select("timestamp", "close")
    assert features.relative_strength(bars, mark).count() == 30
    with pytest.raises(Exception, match="benchmark timestamps repeat"):
        features.relative_strength(bars, mark.unionByName(mark.limit(1))).select("relative_return_5").collect()


def test_checks_find_what_is_wrong(spark):
    columns = "ticker string, timeframe string, pattern_name string, bar_index int, state string, score double, score_structure double, score_momentum double, score_volatility double, score_regime double, score_context double, evidence_for array<string>, evidence_against array<string>, notes array<string>, first_detected_at timestamp, confirmed_at timestamp, invalidated_at timestamp, expired_at timestamp, episode_id int"
    base = ("A", "1Day", "bullish_x")
    tail = (START, None, None, None, 1)
    rows = [
        (*base, 0, "candidate", 0.5, *[0.5] * 5, ["a"], ["b"], [], *tail), (*base, 1, "expired", 1.5, *[0.5] * 5, ["a"], ["a"], [], *tail), (*base, 2, "confirmed", 0.5, *[0.5] * 5, [], [], ["strong buy"], *tail),
        (*base, 3, "confirmed", 0.5, *[0.5] * 5, [], [], [], START, START - dt.timedelta(days=1), None, None, None),
    ]
    frame = spark.createDataFrame([("A", "1Day", START, START + dt.timedelta(days=1)), ("A", "1Day", START, START)], "ticker string, timeframe string, close_time timestamp, vix_available_at timestamp")
    events = spark.createDataFrame([("A", "1Day", 5, 5), ("A", "1Day", 4, 5)], "ticker string, timeframe string, level_asof_index int, origin_index int")
    r = engine.check_results(spark.createDataFrame(rows, columns), frame, events).first()
    assert (r.bad_transitions, r.bad_scores, r.on_both_sides, r.bad_times, r.state_without_episode, r.forbidden_words, r.not_available, r.level_too_young) == (1, 1, 1, 1, 1, 1, 1, 1)


def test_requests(monkeypatch):
    assert readers.source_timeframe("1Week") == "1Day" and readers.source_timeframe("4Hour") == "15Min" and readers.source_timeframe("4Hour", "extended") == "1Hour"
    for bad in (("2Hour", "regular"), ("1Day", "extended"), ("1Day", "night")):
        with pytest.raises(ValueError):
            readers.source_timeframe(*bad)
    monkeypatch.setenv("BAROGRAPH_DATA_FEED", " SIP ")
    assert readers.data_feed() == "sip" and readers.data_feed("otc") == "otc"
    with pytest.raises(ValueError):
        readers.data_feed("none")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], {"k": 1.5})], "i int, names array<string>, m map<string,double>")
    sinks.write(df, f"{tmp_path}/c", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").first().asDict() == {"i": "1", "names": "a;b", "m": '{"k":1.5}'}
    sinks.write(df, f"{tmp_path}/j", "json")
    assert spark.read.json(f"{tmp_path}/j").first().names == ["a", "b"]
    assert sinks.markdown(df).splitlines()[-1] == '| 1 | a;b | {"k":1.5} |'
    with pytest.raises(ValueError):
        sinks.write(df, f"{tmp_path}/x", "xml")
