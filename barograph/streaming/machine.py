"""Streaming twins: the pattern machine over a stream of observed bars, and sessionised bars from a stream of ticks."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barograph.operators.windows import KEYS
from barograph.plans.machine import MACHINES, Tracker, step
from barograph.plans.patterns import MACHINE_OUT


def track_stream(observed: DataFrame) -> DataFrame:
    """States of observe()'s rows that arrive as a stream, in bar order within each micro-batch and across batches.

    State per (series, pattern) is one small tracker. Bars must not arrive late across batches; a bar at or before the last
    one seen is dropped.
    """
    inputs = observed.select(*KEYS, "pattern_name", "pattern_family", "bar_index", "timestamp", "close", "score", "required_ok", "memory_now", "hooks.*")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, tracker = pickle.loads(state.get[0]) if state.exists else (-1, Tracker())  # the state is written by this function only
        pdf = pd.concat(list(frames)).sort_values("bar_index", kind="stable")
        pdf = pdf[pdf["bar_index"] > last]
        rows = [step(tracker, row, MACHINES[row["pattern_family"]]) for row in pdf.to_dict("records")]
        if rows:
            state.update((pickle.dumps((int(pdf["bar_index"].iloc[-1]), tracker)),))
            yield pd.DataFrame(rows).assign(**{c: pdf[c].to_numpy() for c in (*KEYS, "pattern_name", "bar_index")})[[c.split()[0] for c in MACHINE_OUT.split(", ")]]

    return inputs.groupBy(*KEYS, "pattern_name").applyInPandasWithState(run, MACHINE_OUT, "tracker binary", "append", GroupStateTimeout.NoTimeout)


def bars_stream(ticks: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """OHLCV bars of (ticker, timestamp, price) with a watermark; a bar comes out once no tick of it can still arrive."""
    slot = F.window("timestamp", f"{minutes} minutes")
    x = ticks.withWatermark("timestamp", late).groupBy("ticker", slot.alias("_w")).agg(
        F.min_by("price", "timestamp").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "timestamp").alias("close"), F.count("*").cast("double").alias("volume"))
    return x.select("ticker", F.col("_w.start").alias("timestamp"), "open", "high", "low", "close", "volume")
