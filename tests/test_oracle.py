"""The registered queries against their SQL, row by row, on the smallest tables."""

import math
import os
import shutil
from collections import Counter

import duckdb
import pytest

from barograph.plans import oracle, oracle_patterns, registry

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
QUERIES = {
    "atr", "returns", "rolling", "acceleration_states", "recent_flags", "relative_strength", "breadth", "structure_asof", "levels_history", "breakouts", "breakout_recency", "gap_filter", "atr_reversal", "check_bars", "normalize", "raw_bars", "macro_files",
    "vix_file", "news_file", "forecast_file", "weekly", "check_aggregates", "asof_timeframe", "asof_vix", "macro_by_bar", "external_context", "context_snapshot", "redaction", "stability", "garch_filter", "evidence", "patterns", "episodes", "pattern_summary", "pattern_checks", "bar_contexts",
}
SQL = oracle.SQL | oracle_patterns.SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value) + 0.0, 9) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(tuple(map(plain, r)) for r in got.select(*columns).collect()) == Counter(tuple(map(plain, r)) for r in want.fetchall())


def test_every_sql_has_its_query():
    assert set(SQL) <= set(registry.QUERIES)


def test_the_engine_runs_again_when_its_files_change(spark, tmp_path):
    for name in TABLES:
        shutil.copy(f"{SF}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    before = registry._snapshot(spark, str(tmp_path))
    assert before == registry._snapshot(spark, str(tmp_path))
    os.utime(f"{tmp_path}/orders.parquet", (1, 1))
    assert before != registry._snapshot(spark, str(tmp_path))
