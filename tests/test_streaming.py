from pyspark.sql import functions as F

from barograph.plans.machine import HOOKS
from barograph.plans.patterns import track
from barograph.streaming.machine import bars_stream, track_stream


def observed(spark):
    i = F.col("id").cast("int")
    hooks = {k: default().cast(kind).alias(k) for k, (kind, default) in HOOKS.items()}
    hooks |= {"confirm_now": (F.col("id") == 6).alias("confirm_now"), "fail_now": (F.col("id") == 20).alias("fail_now")}
    return spark.range(40).select(
        F.lit("A").alias("ticker"), F.lit("1Day").alias("timeframe"), F.lit("bullish_exhaustion").alias("pattern_name"), F.lit("exhaustion").alias("pattern_family"), i.alias("bar_index"),
        F.timestamp_seconds(F.col("id") * 86400).alias("timestamp"), F.lit(1.0).alias("close"), F.lit(0.9).alias("score"), (F.col("id") >= 2).alias("required_ok"), F.lit(None).cast("string").alias("memory_now"),
        F.struct(*hooks.values()).alias("hooks"))


def drain(stream, name, spark):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_stream_equals_batch(spark, tmp_path):
    rows = observed(spark)
    for k in range(4):  # one file a micro-batch
        rows.where(f"bar_index div 10 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.bar_index, r.state, r.episode_id, r.bars_active) for r in drain(track_stream(stream), "tracked", spark)}
    assert got == {(r.bar_index, r.state, r.episode_id, r.bars_active) for r in track(rows).collect()}
    assert {"candidate", "developing", "confirmed"} <= {s for _, s, _, _ in got}


def test_tick_bars(spark, tmp_path):
    ticks = spark.range(600).select(F.lit("A").alias("ticker"), F.timestamp_seconds(F.col("id") * 10).alias("timestamp"), F.col("id").cast("double").alias("price"))
    ticks.coalesce(1).write.parquet(str(tmp_path / "ticks"))
    bars = drain(bars_stream(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks")), 15), "tickbars", spark)
    assert bars and all(r.volume == 90.0 and r.close - r.open == 89.0 for r in bars)
