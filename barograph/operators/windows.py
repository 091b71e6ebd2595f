"""Frames over a bar series. All share one partitioning and order, so Spark plans one exchange and one sort."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

KEYS = ["ticker", "timeframe"]


def series(keys: list[str] | None = None, order: str = "bar_index") -> WindowSpec:
    return Window.partitionBy(*(keys or KEYS)).orderBy(order)


def last(k: int, w: WindowSpec | None = None) -> WindowSpec:
    """The last k rows, this one included."""
    return (w or series()).rowsBetween(-(k - 1), 0)


def prior(k: int, w: WindowSpec | None = None) -> WindowSpec:
    """The k rows before this one."""
    return (w or series()).rowsBetween(-k, -1)


def guarded(value: Column, of: Column, frame: WindowSpec, least: int) -> Column:
    """An aggregate over a frame, null with fewer than `least` non-null inputs."""
    return F.when(F.count(of).over(frame) >= least, value.over(frame))


def full(aggregate, of: Column, k: int, w: WindowSpec | None = None) -> Column:
    return guarded(aggregate(of), of, last(k, w), k)


def lag(c: Column | str, k: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(c, k).over(w or series())


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))
