import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.operators import features
from barograph.plans import fixtures, oracle, registry

#: 20 closes in cents whose last one equals their mean; added in order as doubles, their mean is below it.
TIE = [23987, 17449, 17734, 22498, 17494, 17214, 17639, 16305, 19159, 18857, 20831, 20164, 17810, 19542, 22750, 20074, 16265, 22018, 17523, 19227]


@pytest.mark.parametrize("scale", [1, 1e-6, 12345.67])
def test_a_close_equal_to_its_mean_is_not_above_it(spark, scale):
    """Three members: at its mean, a cent above and a cent below it (in the last close); at any size of price."""
    assert 20 * TIE[-1] == sum(TIE)
    closes = {"A": TIE, "B": [*TIE[:-1], TIE[-1] + 1], "C": [*TIE[:-1], TIE[-1] - 1]}
    mean = 0.0
    for c in TIE:
        mean += c / 100.0
    assert mean / 20 < TIE[-1] / 100.0
    rows = [(t, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), *[c * scale / 100.0] * 3) for t, cs in closes.items() for i, c in enumerate(cs)]
    bars = spark.createDataFrame(rows, "ticker string, timestamp timestamp, close double, high double, low double")
    got = features.breadth(bars, list(closes), 3).orderBy("timestamp").collect()
    assert [r.breadth_sma20 for r in got] == [None] * 19 + [1 / 3]


@pytest.mark.parametrize("k", [20, 50, 200])
def test_means_by_blocks_equal_their_sql_to_the_last_bit(spark, k):
    """AMERICA and MIDDLE EAST lie in one hash partition of DuckDB's; 603 rows shift the blocks of the second."""
    walk = random.Random(k)
    rows = [(t, i, walk.randint(15000, 25000) / 100.0 if (t, i) != ("AMERICA", 90) else None) for t in ("AMERICA", "MIDDLE EAST") for i in range(603)]
    w = Window.partitionBy("t").orderBy("i")
    position = F.col("i") + F.when(F.col("t") == "MIDDLE EAST", 603).otherwise(0)
    x = spark.createDataFrame(rows, "t string, i int, c double").select("t", "i", features.mean_by_blocks("c", k, position, w).alias("m"))
    con = duckdb.connect()
    con.execute("create table x (t varchar, i int, c double)")
    con.executemany("insert into x values (?, ?, ?)", rows)
    frame = f"over (partition by t order by i rows between {k - 1} preceding and current row)"
    want = con.execute(f"select t, i, case when count(c) {frame} = {k} then avg(c) {frame} end from x order by t, i").fetchall()
    assert [tuple(r) for r in x.orderBy("t", "i").collect()] == want
    assert sum(m is not None for _, _, m in want) > 600


def test_breadth_of_a_table_with_a_tie_equals_its_sql(spark):
    """sf0.01 has a close of MIDDLE EAST that equals its 50-day mean."""
    data = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation", "region"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = {r[0]: r for r in con.execute(oracle.SQL["breadth"]).fetchall()}
    got = {r.day: tuple(r) for r in registry.QUERIES["breadth"](spark, data).collect()}
    assert got == want


def test_rows_before_come_from_the_series_in_front(spark):
    bars = spark.createDataFrame([(t, tf, i) for t, n in (("AMERICA", 3), ("MIDDLE EAST", 2), ("ASIA", 1)) for tf in ("1Day", "1Week") for i in range(n if tf == "1Day" else 1)], "ticker string, timeframe string, bar_index int")
    got = {(r.ticker, r.timeframe, r.rows_before) for r in fixtures.in_sql_order(bars).collect()}
    assert got == {("AMERICA", "1Day", 0), ("AMERICA", "1Week", 0), ("ASIA", "1Day", 0), ("ASIA", "1Week", 0), ("MIDDLE EAST", "1Day", 3), ("MIDDLE EAST", "1Week", 1)}
    assert fixtures.in_sql_order(bars).count() == bars.count()
