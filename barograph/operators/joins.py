"""As-of, range and densifying joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

C = F.col


#: Width of the time buckets that an as-of join without keys is dealt by.
BUCKET_SECONDS = 86400


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str] | None = None, columns: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Each left row with the last right row whose `right_on` is at or before its `left_on`, within equal `by`.

    A union and one window: a single shuffle on `by`, nothing held beyond the sort. Of right rows of equal time the greatest
    by `columns` counts. Without `by` rows are dealt by buckets of time, and what a bucket inherits from earlier ones comes from
    a table of one row a bucket: no task sees all rows. A null `left_on` finds nothing.
    """
    columns = columns or [c for c in right.columns if c not in (by or [])]
    payload = F.struct(*columns)
    bucket = lambda c: F.floor(F.unix_timestamp(c) / BUCKET_SECONDS)
    keys = lambda at: [C(c).alias(f"_k{i}") for i, c in enumerate(by)] if by else [bucket(C(at)).alias("_k0")]
    l = left.select(F.struct(*left.columns).alias("_l"), *keys(left_on), C(left_on).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_r"))
    r = right.where(C(right_on).isNotNull()).select(F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), *keys(right_on), C(right_on).alias("_at"), F.lit(0).alias("_side"), payload.alias("_r"))
    w = Window.partitionBy(*(f"_k{i}" for i in range(len(by) if by else 1))).orderBy("_at", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    x = l.unionByName(r).withColumn("_r", F.last("_r", True).over(w)).where("_side = 1")
    if not by:
        ends = l.select("_k0", F.lit(None).cast(l.schema["_r"].dataType).alias("_e"), F.lit(None).cast("timestamp").alias("_t")).where("_k0 is not null").distinct()
        ends = ends.unionByName(r.select("_k0", C("_r").alias("_e"), C("_at").cast("timestamp").alias("_t")))
        ends = ends.groupBy("_k0").agg(F.max(F.when(C("_e").isNotNull(), F.struct("_t", "_e"))).alias("_e"))  # one row a bucket
        earlier = Window.orderBy("_k0").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select("_k0", F.last(C("_e")["_e"], True).over(earlier).alias("_e"))
        x = x.join(ends, "_k0", "left").withColumn("_r", F.when(C("_r").isNotNull(), C("_r")).otherwise(C("_e")))
    return x.select("_l.*", *(C(f"_r.{c}").alias(prefix + c) for c in columns))


def range_join(left: DataFrame, right: DataFrame, at: str, stamp: str, span_seconds: int, by: list[str]) -> DataFrame:
    """Pairs with `stamp` in (at - span, at] and equal `by`, through buckets as wide as the span: an equi-join, not a cross join."""
    bucket = lambda c: F.floor(F.unix_timestamp(c) / span_seconds)
    l = left.withColumn("_bucket", F.explode(F.array(bucket(C(at)), bucket(C(at)) - 1)))
    r = right.withColumn("_bucket", bucket(C(stamp)))
    inside = (C(stamp) <= C(at)) & (C(stamp) > C(at) - F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {span_seconds})"))
    return l.join(r, [*by, "_bucket"]).where(inside).drop("_bucket")


def common_dates(df: DataFrame, key: str, date: str) -> DataFrame:
    """Rows of the dates that every key has."""
    n = df.select(key).distinct().count()  # number of keys: assets of a study
    dates = df.groupBy(date).agg(F.count_distinct(key).alias("_n")).where(C("_n") == n).select(date)
    return df.join(dates, date, "left_semi")


def keep_last(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The last row of each key in a full order."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() if isinstance(o, str) else o for o in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
