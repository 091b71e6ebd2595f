import datetime as dt

import pytest
from pyspark.sql import functions as F

from barograph.plans import registry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small lineitem, supplier, nation and region: one series with a session on each weekday of 2000-01-05 .. 2001-11-07."""
    d = str(tmp_path_factory.mktemp("tables"))
    days = [dt.date(2000, 1, 5) + dt.timedelta(days=i) for i in range(673)]
    rows = [(i * 7919 % 1000, 1, i * 31 % 977, 5.0 + i % 3, x) for i, x in enumerate(x for x in days if x.weekday() < 5)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_orderkey long, l_quantity double, l_shipdate date").write.parquet(f"{d}/lineitem.parquet")
    for name, row, schema in (("supplier", (1, 1), "s_suppkey long, s_nationkey long"), ("nation", (1, 1), "n_nationkey long, n_regionkey long"), ("region", (1, "ASIA"), "r_regionkey long, r_name string")):
        spark.createDataFrame([row], schema).write.parquet(f"{d}/{name}.parquet")
    return d


def test_weeks_hold_every_session(spark, tables):
    bars = registry.q_walk_bars(spark, tables)
    weeks = registry.q_weekly(spark, tables).orderBy("at").collect()
    assert len(weeks) == 97 and sum(w.volume for w in weeks) == bars.agg(F.sum("volume")).first()[0]
    assert [w.is_complete for w in weeks] == [False] + [True] * 95 + [False]  # it begins and ends on a Wednesday
    assert registry.q_check_aggregates(spark, tables).first().only_fine == 0
    last = registry.q_asof_timeframe(spark, tables).orderBy("bar_index").collect()[-1]
    assert last.week_close == weeks[-1].close
    assert registry._weekly(spark, tables).limit(0).count() == 0


def test_redaction_reads_the_whole_text(spark, tmp_path):
    text = "x" * 60 + " api_key=abc&b=1 hunter2 " + "y" * 5000 + " token=zzz end"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.redacted for r in registry.q_redaction(spark, str(tmp_path)).collect()}
    assert got[1].endswith("x" * 60 + " api_key=[REDACTED]&b=1 [REDACTED] " + "y" * 5000 + " token=[REDACTED] end") and got[2] is None
