"""Market structure as it was known at each bar: swings, states, levels, breakouts, gaps.

Swing rows: ticker, timeframe, type, bar_index, confirmation_index, timestamp, confirmed_at, price_level, confirmation_lag_bars,
method. A row counts from its confirmation_index on.
"""

from __future__ import annotations

import bisect
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.functions.scalars import structural_label
from barograph.operators.features import with_atr
from barograph.operators.windows import KEYS, guarded, lag, prior, ratio, series

C = F.col
SWINGS = "ticker string, timeframe string, type string, bar_index int, confirmation_index int, timestamp timestamp, confirmed_at timestamp, price_level double, confirmation_lag_bars int, method string"
LEVELS = (
    "ticker string, timeframe string, asof_index int, asof_timestamp timestamp, price_level double, type string, touch_count int, first_touch timestamp, last_touch timestamp, "
    "distance_from_current_price double, strength_score double, available_at timestamp"
)
GAPS = "ticker string, timeframe string, bar_index int, timestamp timestamp, gap_index int, gap_timestamp timestamp, type string, size_abs double, size_pct double, size_atr double, filled boolean, time_to_fill_bars int, state string"


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys into as many parts as the session's shuffles have: groups that cost much more time than their bytes show
    would otherwise be put together in a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def per_series(df: DataFrame, function, schema: str) -> DataFrame:
    """function(pandas frame of one series in bar order) for every (ticker, timeframe). A task holds one series at a time."""
    return dealt(df, *KEYS).groupBy(*KEYS).applyInPandas(lambda pdf: function(pdf.sort_values("bar_index", kind="stable").reset_index(drop=True)), schema)


# --- swings -----------------------------------------------------------------------------------------------------------


def confirmed_swings(bars: DataFrame, left: int = 3, right: int = 2) -> DataFrame:
    """Fractal pivots, strictly beyond `left` bars before and `right` bars after; published `right` bars later."""
    if left < 1 or right < 1:
        raise ValueError("left and right must be positive")
    w = series()
    before, after = w.rowsBetween(-left, -1), w.rowsBetween(1, right)
    whole = (F.count("high").over(before) == left) & (F.count("high").over(after) == right)
    x = bars.withColumns({
        "_high": whole & (C("high") > F.max("high").over(before)) & (C("high") > F.max("high").over(after)),
        "_low": whole & (C("low") < F.min("low").over(before)) & (C("low") < F.min("low").over(after)),
        "confirmed_at": F.lead("timestamp", right).over(w),
    })
    kinds = F.array_compact(F.array(F.when(C("_high"), F.struct(F.lit("swing_high").alias("type"), C("high").alias("price"))), F.when(C("_low"), F.struct(F.lit("swing_low").alias("type"), C("low").alias("price")))))
    x = x.where("_high or _low").withColumn("_kind", F.explode(kinds))
    return x.select(*KEYS, "_kind.type", C("bar_index").cast("int").alias("bar_index"), (C("bar_index") + right).cast("int").alias("confirmation_index"), "timestamp", "confirmed_at", C("_kind.price").alias("price_level"), F.lit(right).alias("confirmation_lag_bars"), F.lit("fractal").alias("method"))


def atr_reversal_swings(bars: DataFrame, multiple: float = 1.5, window: int = 14, reversal: float = 0.0) -> DataFrame:
    """Zig-zag: a running extreme is confirmed once price reverses by max(multiple * ATR, reversal * extreme). Sequential per series."""
    if multiple < 0 or reversal < 0 or multiple == reversal == 0:
        raise ValueError("a positive ATR multiple or reversal share is needed")

    def zigzag(pdf: pd.DataFrame) -> pd.DataFrame:
        high, low, scale = (pdf[c].to_numpy(float) for c in ("high", "low", "_atr"))
        scale = np.where(np.isnan(scale), np.inf, scale * multiple)
        found, way, top, bottom = [], 0, 0, 0
        for i in range(1, len(pdf)):
            if way >= 0:
                if high[i] > high[top]:
                    top = i
                if i > top and high[top] - low[i] >= max(scale[i], high[top] * reversal):
                    found.append((top, i, "swing_high", high[top]))
                    way, bottom = -1, i
            if way <= 0:
                if low[i] < low[bottom]:
                    bottom = i
                if i > bottom and high[i] - low[bottom] >= max(scale[i], low[bottom] * reversal):
                    found.append((bottom, i, "swing_low", low[bottom]))
                    way, top = 1, i
        at, when = np.array([f[0] for f in found], int), np.array([f[1] for f in found], int)
        base = pdf["bar_index"].to_numpy()
        return pd.DataFrame({
            "ticker": pdf["ticker"].iloc[0], "timeframe": pdf["timeframe"].iloc[0], "type": [f[2] for f in found], "bar_index": base[at], "confirmation_index": base[when],
            "timestamp": pdf["timestamp"].to_numpy()[at], "confirmed_at": pdf["timestamp"].to_numpy()[when], "price_level": [f[3] for f in found],
            "confirmation_lag_bars": when - at, "method": "atr_reversal"})

    return per_series(with_atr(bars, window, "_atr").select(*KEYS, "bar_index", "timestamp", "high", "low", "_atr"), zigzag, SWINGS)


def classify_swings(swings: DataFrame, equality: float = 0.005) -> DataFrame:
    """Labels each swing against the one before of its type, in order of confirmation. The first has none."""
    w = Window.partitionBy(*KEYS, "type").orderBy("confirmation_index", "bar_index")
    before, price = lag("price_level", 1, w), C("price_level")
    high = C("type") == "swing_high"
    label = F.when(before.isNull(), None).when(F.abs(price - before) / before <= equality, "EQ").when(high, F.when(price > before, "HH").otherwise("LH")).otherwise(F.when(price > before, "HL").otherwise("LL"))
    return swings.withColumn("structure_label", label)


def structural_state(classified: DataFrame, asof_index: Column | int | None = None) -> DataFrame:
    """(ticker, timeframe, high_label, low_label, structural_state) from swings confirmed by asof_index."""
    known = classified if asof_index is None else classified.where(C("confirmation_index") <= asof_index)
    order = F.struct("confirmation_index", "bar_index")
    pick = lambda kind: F.max_by(F.when(C("type") == kind, C("structure_label")), F.when(C("type") == kind, order))
    x = known.groupBy(*KEYS).agg(pick("swing_high").alias("high_label"), pick("swing_low").alias("low_label"))
    return x.withColumn("structural_state", structural_label(C("high_label"), C("low_label")))


def structure_asof(bars: DataFrame, swings: DataFrame, change_bars: int = 10) -> DataFrame:
    """bars with the structure known at each bar: last and previous pivots, labels, state, whether it changed."""
    w = Window.partitionBy(*KEYS, "type").orderBy("confirmation_index", "bar_index")
    marks = classify_swings(swings).withColumns({"_prev": lag("price_level", 1, w), "_prev_index": lag("bar_index", 1, w)})
    pivot = F.struct(C("price_level").alias("price"), C("bar_index").alias("index"), C("structure_label").alias("label"), C("_prev").alias("prev"), C("_prev_index").alias("prev_index"))
    pick = lambda kind: F.max_by(F.when(C("type") == kind, pivot), F.when(C("type") == kind, C("bar_index")))
    marks = marks.groupBy(*KEYS, C("confirmation_index").alias("bar_index")).agg(pick("swing_high").alias("_h"), pick("swing_low").alias("_l"))
    so_far = series().rowsBetween(Window.unboundedPreceding, 0)
    x = bars.join(marks, [*KEYS, "bar_index"], "left")
    x = x.withColumns({"new_swing_high": C("_h").isNotNull(), "new_swing_low": C("_l").isNotNull(), "_high": F.last("_h", True).over(so_far), "_low": F.last("_l", True).over(so_far)})
    fields = {"last_{}": "price", "last_{}_index": "index", "last_{}_label": "label", "prev_{}": "prev", "prev_{}_index": "prev_index"}
    x = x.withColumns({name.format(side): C(f"_{side}.{field}") for side in ("high", "low") for name, field in fields.items()})
    x = x.withColumn("structural_state", structural_label(C("last_high_label"), C("last_low_label")))
    return x.withColumn("structure_changed_recent", C("structural_state") != lag("structural_state", change_bars)).drop("_h", "_l", "_high", "_low")


# --- levels -----------------------------------------------------------------------------------------------------------


#: Bars whose level sets one task works out at a time.
BLOCK = 256


def cluster(prices: np.ndarray, tolerance: float) -> np.ndarray:
    """First members of the groups of ascending prices: one joins the last group while within `tolerance` of its running mean.

    A step of more than `tolerance` always begins a group, as the mean is at most the price before; only what lies between
    such steps is looked at one by one.
    """
    starts = np.flatnonzero(np.append(True, np.diff(prices) > tolerance))
    size = np.diff(np.append(starts, len(prices)))
    more = []
    for lo, n in zip(starts[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        total, count = prices[lo].item(), 1
        for i in range(lo + 1, lo + n):
            p = prices[i].item()
            if p - total / count <= tolerance:
                total, count = total + p, count + 1
            else:
                more.append(i)
                total, count = p, 1
    return np.sort(np.concatenate([starts, np.array(more, np.int64)])) if more else starts


def running_median(bars: DataFrame, column: str, name: str) -> DataFrame:
    """(series, bar_index, name): the median of a column's values so far, from a sorted list that grows by one a bar."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        so_far: list[float] = []
        out = np.full(len(pdf), np.nan)
        for i, v in enumerate(pdf[column].tolist()):
            if v is not None and v == v:
                bisect.insort(so_far, v)
            if so_far:
                n = len(so_far)
                out[i] = (so_far[(n - 1) // 2] + so_far[n // 2]) / 2
        return pd.DataFrame({"ticker": pdf["ticker"], "timeframe": pdf["timeframe"], "bar_index": pdf["bar_index"], name: out})

    return per_series(bars.select(*KEYS, "bar_index", column), run, f"ticker string, timeframe string, bar_index int, {name} double")


def levels_history(bars: DataFrame, swings: DataFrame, atr_tolerance: float = 0.5, pct_tolerance: float = 0.005, touches: int = 2, every: int = 1) -> DataFrame:
    """Level sets as of every bar (or every `every`-th): clusters of the swings known then, within max(tolerances) of that bar.

    Sequential in prices, so a grouped map, over (series, block of BLOCK bars): each block gets the swings confirmed by its end,
    so that a long series is many tasks. ATR comes from windows, the volume's median so far from one pass.
    """
    block = lambda c: F.floor(C(c) / BLOCK).cast("int")
    x = with_atr(bars, 14, "_atr").select(*KEYS, C("bar_index").cast("int").alias("bar_index"), "timestamp", "close", "volume", "_atr").join(running_median(bars, "volume", "_base"), [*KEYS, "bar_index"])
    end = bars.groupBy(*KEYS).agg(F.max("bar_index").alias("_end"))
    s = swings.join(bars.select(*KEYS, "bar_index", "volume"), [*KEYS, "bar_index"]).join(end, KEYS).where(C("confirmation_index") <= C("_end"))
    s = s.withColumn("_block", F.explode(F.sequence(block("confirmation_index"), block("_end"))))
    names = ["bar_index", "timestamp", "close", "volume", "_atr", "_base", "price_level", "type", "confirmation_index", "confirmed_at", "_block"]
    empty = lambda c, kind: F.lit(None).cast(kind).alias(c)
    x = x.withColumn("_block", block("bar_index")).select(*KEYS, *names[:6], empty("price_level", "double"), empty("type", "string"), empty("confirmation_index", "int"), empty("confirmed_at", "timestamp"), "_block")
    s = s.select(*KEYS, C("bar_index").cast("int").alias("bar_index"), "timestamp", empty("close", "double"), "volume", empty("_atr", "double"), empty("_base", "double"), *names[6:])
    columns = [c.split()[0] for c in LEVELS.split(", ")]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        b = pdf[pdf["price_level"].isna()].sort_values("bar_index").reset_index(drop=True)
        k = pdf[pdf["price_level"].notna()].sort_values(["price_level", "bar_index", "type"], kind="stable")
        if not len(b) or not len(k):
            return pd.DataFrame(columns=columns)
        close, scale, base, index = (b[c].to_numpy(float) for c in ("close", "_atr", "_base", "bar_index"))
        price, confirmed, pivot_volume = k["price_level"].to_numpy(float), k["confirmation_index"].to_numpy(int), k["volume"].to_numpy(float)
        high, seen, known_at = (k["type"].to_numpy() == "swing_high").astype(int), k["timestamp"].to_numpy(), k["confirmed_at"].to_numpy()
        out: dict[str, list] = {c: [] for c in ("bar", "price_level", "type", "touch_count", "first_touch", "last_touch", "distance_from_current_price", "strength_score", "available_at")}
        for i in range(len(b)):
            if every > 1 and int(index[i]) % every:
                continue
            known = np.flatnonzero(confirmed <= index[i])
            if not len(known):
                continue
            tolerance = max(0.0 if np.isnan(scale[i]) else scale[i] * atr_tolerance, close[i] * pct_tolerance)
            p = price[known]
            cut = cluster(p, tolerance)
            size = np.diff(np.append(cut, len(p)))
            keep = size >= touches
            if not keep.any():
                continue
            highs = np.add.reduceat(high[known], cut)[keep]
            last = np.maximum.reduceat(confirmed[known], cut)[keep]
            mean = np.round((np.add.reduceat(p, cut) / size)[keep], 9)  # so that a mean that equals a close is equal to it
            volume = np.add.reduceat(pivot_volume[known], cut)[keep]
            size = size[keep]
            factor = np.minimum(volume / size / base[i], 2) if base[i] > 0 else np.ones(len(size))
            strength = np.log1p(size) / (1 + (index[i] - last) / 20) * factor
            out["bar"].append(np.full(len(size), i))
            out["price_level"].append(mean)
            out["type"].append(np.where(highs == size, "resistance", np.where(highs == 0, "support", "mixed")))
            out["touch_count"].append(size)
            out["first_touch"].append(np.minimum.reduceat(seen[known], cut)[keep])
            out["last_touch"].append(np.maximum.reduceat(seen[known], cut)[keep])
            out["distance_from_current_price"].append(mean / close[i] - 1)
            out["strength_score"].append(np.round(strength, 4))
            out["available_at"].append(np.maximum.reduceat(known_at[known], cut)[keep])
        if not out["bar"]:
            return pd.DataFrame(columns=columns)
        done = pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})
        at = done.pop("bar").to_numpy()
        done = done.assign(asof_index=index[at].astype(int), asof_timestamp=b["timestamp"].to_numpy()[at], ticker=pdf["ticker"].iloc[0], timeframe=pdf["timeframe"].iloc[0])
        return done[columns]

    return dealt(x.unionByName(s), *KEYS, "_block").groupBy(*KEYS, "_block").applyInPandas(fold, LEVELS)


def levels_asof(bars: DataFrame, swings: DataFrame, at: Column, **options) -> DataFrame:
    """Levels known at a moment: those of the last bar labelled at or before it; none before the first bar."""
    prefix = bars.where(C("timestamp") <= at)
    last_index = prefix.groupBy(*KEYS).agg(F.max("bar_index").cast("int").alias("asof_index"))
    known = swings.join(last_index, KEYS).where(C("confirmation_index") <= C("asof_index")).drop("asof_index")
    return levels_history(prefix, known, **options).join(last_index, [*KEYS, "asof_index"], "left_semi")


def nearest_levels(bars: DataFrame, history: DataFrame) -> DataFrame:
    """bars (with atr) with the nearest support below and resistance above the close, strictly, and distances in ATR."""
    x = history.select(*KEYS, C("asof_index").alias("bar_index"), "price_level", "type", "touch_count").join(bars.select(*KEYS, "bar_index", "close"), [*KEYS, "bar_index"])
    below = C("type").isin("support", "mixed") & (C("price_level") < C("close"))
    above = C("type").isin("resistance", "mixed") & (C("price_level") > C("close"))
    x = x.groupBy(*KEYS, "bar_index").agg(
        F.max(F.when(below, C("price_level"))).alias("nearest_support"), F.max_by("touch_count", F.when(below, C("price_level"))).alias("support_touches"),
        F.min(F.when(above, C("price_level"))).alias("nearest_resistance"), F.min_by("touch_count", F.when(above, C("price_level"))).alias("resistance_touches"))
    safe = F.when(C("atr") > 0, C("atr"))
    return bars.join(x, [*KEYS, "bar_index"], "left").withColumns({"support_dist_atr": (C("close") - C("nearest_support")) / safe, "resistance_dist_atr": (C("nearest_resistance") - C("close")) / safe})


# --- breakouts --------------------------------------------------------------------------------------------------------


def _crossings(bars: DataFrame, fail_within: int, confirm_bars: int) -> DataFrame:
    """bars with what a scan at each bar needs: the close before, ATR, relative volume and the bars that follow."""
    x = with_atr(bars, 14, "_atr")
    ahead = series().rowsBetween(1, max(fail_within, confirm_bars))
    return x.select(
        *KEYS, "bar_index", "timestamp", "close", C("_atr").alias("scale"), lag("close").alias("before"),
        ratio(C("volume"), guarded(F.avg("volume"), C("volume"), prior(20), 5)).alias("relative_volume"),
        F.collect_list(F.struct("close", "high", "low", "timestamp")).over(ahead).alias("ahead"))


def scan_breakouts(crossed: DataFrame, min_distance: float, min_volume: float, confirm_bars: int, fail_within: int) -> DataFrame:
    """Events of (bar, level) pairs: crossed has a bar's columns from _crossings() and level, level_type, level_touch_count, level_asof_index."""
    up = (C("before") <= C("level")) & (C("level") < C("close"))
    down = (C("before") >= C("level")) & (C("level") > C("close"))
    way = F.when(up, 1).when(down, -1)
    amplitude = F.abs(C("close") - C("level"))
    x = crossed.where("scale > 0").withColumns({"way": way, "distance": amplitude / C("scale"), "amplitude": amplitude, "volume_ok": F.coalesce(C("relative_volume") >= min_volume, F.lit(False))})
    x = x.where(C("way").isNotNull() & (C("distance") >= min_distance))
    inside = "transform(ahead, (b, k) -> if(way * (b.close - level) <= 0, k + 1, null))"
    touched = "transform(ahead, (b, k) -> if(if(way = 1, b.low <= level, b.high >= level), k + 1, null))"
    x = x.withColumns({"_f": F.expr(f"array_min(array_compact({inside}))"), "_t": F.expr(f"array_min(array_compact({touched}))")})
    wait = confirm_bars - 1
    near = F.least(C("distance"), F.lit(1.0)) * 0.25
    volume_part = C("volume_ok").cast("double") * 0.25
    n = F.size("ahead")

    def event(condition, state, offset, outside, retest, failure, confidence):
        return F.when(condition, F.struct(state.alias("state"), offset.cast("int").alias("offset"), outside.cast("int").alias("outside_bars"), retest.alias("retest"), failure.cast("int").alias("failure_bars"), F.round(F.least(F.lit(1.0), confidence), 3).alias("confidence")))

    never = F.lit(None).cast("int")
    stays = C("_f").isNull() | (C("_f") > wait)
    kept = F.coalesce(C("_t") <= wait, F.lit(False))
    failed = C("_f").isNotNull() & (C("_f") <= fail_within)
    touched_before = F.coalesce(C("_t") < C("_f"), F.lit(False))
    first = event(F.lit(True), F.lit("breakout_candidate"), F.lit(0), F.lit(1), F.lit(False), never, 0.25 + near + volume_part)
    second = event(C("volume_ok") & stays & (n >= wait) & F.lit(wait > 0), F.lit("breakout_confirmed"), F.lit(wait), F.lit(confirm_bars), kept, never, 0.5 + near + kept.cast("double") * 0.25)
    third = event(failed, F.when(C("way") == 1, "fake_breakout_up").otherwise("fake_breakout_down"), C("_f"), C("_f"), touched_before, C("_f"), 0.5 + near + (C("_f") <= 2).cast("double") * 0.25)
    x = x.withColumn("e", F.explode(F.array_compact(F.array(first, second, third))))
    stamp = F.when(C("e.offset") == 0, C("timestamp")).otherwise(F.element_at("ahead", F.greatest(C("e.offset"), F.lit(1)))["timestamp"])
    return x.select(
        *KEYS, (C("bar_index") + C("e.offset")).cast("int").alias("bar_index"), stamp.alias("timestamp"), C("bar_index").cast("int").alias("origin_index"), "level", "level_type", "level_touch_count", "level_asof_index",
        F.when(C("way") == 1, "up").otherwise("down").alias("direction"), "e.state", C("distance").alias("distance_atr"), "relative_volume", "e.outside_bars", "e.retest", "e.failure_bars",
        C("amplitude").alias("breakout_amplitude"), "e.confidence")


def detect_breakouts(bars: DataFrame, history: DataFrame, min_distance: float = 0.1, min_volume: float = 1.0, confirm_bars: int = 2, fail_within: int = 5) -> DataFrame:
    """Closes that cross levels known at the bar before, their confirmations and failures, each dated where observed."""
    levels = history.select(*KEYS, (C("asof_index") + 1).alias("bar_index"), C("price_level").alias("level"), C("type").alias("level_type"), C("touch_count").alias("level_touch_count"), C("asof_index").alias("level_asof_index"))
    return scan_breakouts(_crossings(bars, fail_within, confirm_bars).join(levels, [*KEYS, "bar_index"]), min_distance, min_volume, confirm_bars, fail_within)


def detect_breakouts_fixed_levels(bars: DataFrame, levels: DataFrame, min_distance: float = 0.1, min_volume: float = 1.0, confirm_bars: int = 2, fail_within: int = 5) -> DataFrame:
    """The same against given levels (ticker, timeframe, price_level, available_at), usable strictly after available_at."""
    if "available_at" not in levels.columns:
        raise ValueError("fixed levels need available_at")
    given = levels.select(C("ticker").alias("_t"), C("timeframe").alias("_f"), C("price_level").alias("level"), "available_at", F.lit(None).cast("string").alias("level_type"), F.lit(None).cast("int").alias("level_touch_count"), F.lit(None).cast("int").alias("level_asof_index"))
    x = _crossings(bars, fail_within, confirm_bars)
    crossed = x.join(given, (C("ticker") == C("_t")) & (C("timeframe") == C("_f")) & (C("available_at") < C("timestamp")) & C("level").between(F.least("before", "close"), F.greatest("before", "close")))
    return scan_breakouts(crossed.drop("_t", "_f", "available_at"), min_distance, min_volume, confirm_bars, fail_within)


def breakout_recency(bars: DataFrame, events: DataFrame, max_age: int = 5) -> DataFrame:
    """bars with the latest breakout and the latest fake event of at most max_age bars ago; the later event in a bar wins."""
    fake = F.startswith(C("state"), F.lit("fake"))
    order = F.struct("origin_index", "level")
    pick = lambda cond: F.max_by(F.when(cond, F.struct("state", "direction", "bar_index")), F.when(cond, order))
    marks = events.groupBy(*KEYS, "bar_index").agg(pick(~fake).alias("_b"), pick(fake).alias("_f"))
    so_far = series().rowsBetween(-max_age, 0)
    x = bars.join(marks, [*KEYS, "bar_index"], "left").withColumns({"_b": F.last("_b", True).over(so_far), "_f": F.last("_f", True).over(so_far)})
    return x.withColumns({
        "breakout_state": F.coalesce(C("_b.state"), F.lit("inactive")), "breakout_direction": C("_b.direction"), "breakout_age": C("bar_index") - C("_b.bar_index"),
        "fake_breakout_state": F.coalesce(C("_f.state"), F.lit("inactive")), "fake_breakout_age": C("bar_index") - C("_f.bar_index"),
    }).drop("_b", "_f")


# --- gaps -------------------------------------------------------------------------------------------------------------


def detect_gaps(bars: DataFrame, min_gap: float = 0.002, window: int = 14) -> DataFrame:
    """Opening gaps and their fills, each dated where observed. Open gaps wait in two heaps, so a series costs n log n."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        o, h, l, c, a = (pdf[k].to_numpy(float) for k in ("open", "high", "low", "close", "_atr"))
        stamps, index = pdf["timestamp"].to_numpy(), pdf["bar_index"].to_numpy()
        rows, ups, downs = [], [], []
        for i in range(1, len(pdf)):
            done = []
            while ups and -ups[0][0] >= l[i]:
                done.append(heapq.heappop(ups)[1])
            while downs and downs[0][0] <= h[i]:
                done.append(heapq.heappop(downs)[1])
            rows += [(i, g, True) for g in sorted(done)]
            before, size = c[i - 1], o[i] - c[i - 1]
            if abs(size) / before < min_gap:
                continue
            rows.append((i, i, False))
            if (size > 0 and l[i] <= before) or (size < 0 and h[i] >= before):
                rows.append((i, i, True))
            else:
                heapq.heappush(*((ups, (-before, i)) if size > 0 else (downs, (before, i))))
        at, gap = np.array([r[0] for r in rows], int), np.array([r[1] for r in rows], int)
        filled = np.array([r[2] for r in rows], bool)
        size, before, scale = o[gap] - c[gap - 1], c[gap - 1], a[gap - 1]
        return pd.DataFrame({
            "ticker": pdf["ticker"].iloc[0], "timeframe": pdf["timeframe"].iloc[0], "bar_index": index[at], "timestamp": stamps[at], "gap_index": index[gap], "gap_timestamp": stamps[gap],
            "type": np.where(size > 0, "gap_up", "gap_down"), "size_abs": np.abs(size), "size_pct": np.abs(size) / before,
            "size_atr": np.abs(size) / np.where(scale > 0, scale, np.nan),
            "filled": filled, "time_to_fill_bars": pd.array(np.where(filled, at - gap, -1), dtype="Int32"), "state": np.where(filled, "gap_fill", "unfilled_gap")})

    found = per_series(with_atr(bars, window, "_atr").select(*KEYS, "bar_index", "timestamp", "open", "high", "low", "close", "_atr"), scan, GAPS)
    return found.withColumns({"time_to_fill_bars": F.when(C("filled"), C("time_to_fill_bars")), "size_atr": F.nanvl("size_atr", F.lit(None).cast("double"))})


def filtered_gaps(bars: DataFrame, gaps: DataFrame, min_pct: float = 0.005, min_atr: float = 0.5, recent: int = 3) -> DataFrame:
    """bars with flags for gaps of enough size that opened in the last `recent` bars."""
    kept = gaps.where((C("state") == "unfilled_gap") & (C("size_pct") >= min_pct) & (C("size_atr") >= min_atr))
    marks = kept.groupBy(*KEYS, C("gap_index").alias("bar_index")).agg(F.max((C("type") == "gap_up").cast("int")).alias("_u"), F.max((C("type") == "gap_down").cast("int")).alias("_d"))
    frame = series().rowsBetween(-(recent - 1), 0)
    x = bars.join(marks, [*KEYS, "bar_index"], "left")
    return x.withColumns({"gap_up_recent": F.coalesce(F.max("_u").over(frame), F.lit(0)) == 1, "gap_down_recent": F.coalesce(F.max("_d").over(frame), F.lit(0)) == 1}).drop("_u", "_d")


def gap_counts(gaps: DataFrame, min_pct: float = 0.005, min_atr: float = 0.5) -> DataFrame:
    opened = gaps.where("state = 'unfilled_gap'")
    kept = F.count_if((C("size_pct") >= min_pct) & (C("size_atr") >= min_atr))
    return opened.groupBy(*KEYS).agg(F.count("*").alias("gaps_detected"), kept.alias("gaps_kept"), (F.count("*") - kept).alias("gaps_discarded"))


# --- snapshot ---------------------------------------------------------------------------------------------------------


def structure_snapshot(bars: DataFrame, evidence: DataFrame, classified: DataFrame) -> DataFrame:
    """One row per series for its last bar, from an evidence frame: state, pivots, levels, events, compression, gaps, strength."""
    last = bars.groupBy(*KEYS).agg(F.max("bar_index").alias("bar_index"))
    labels = F.transform(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("confirmation_index", "bar_index", "structure_label")))), 1, 4), lambda s: s["structure_label"])
    recent = classified.where("structure_label is not null").groupBy(*KEYS).agg(labels.alias("last_labels"))
    keep = [
        "structural_state", "last_high", "last_low", "last_high_label", "last_low_label", "nearest_support", "nearest_resistance", "support_dist_atr", "resistance_dist_atr", "breakout_state",
        "breakout_direction", "fake_breakout_state", "volatility_compression", "volatility_expansion", "compression_duration", "acceleration_state", "exhaustion_candidate", "gap_up_recent", "gap_down_recent",
        "relative_return_20", "ratio_zscore",
    ]
    x = evidence.join(last, [*KEYS, "bar_index"]).select(*KEYS, "bar_index", "timestamp", "close", *(c for c in keep if c in evidence.columns))
    return x.join(recent, KEYS, "left")
