"""Sinks: CSV, JSON and Parquet directories, and a Markdown summary of a small frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON, so that CSV can hold them; arrays of strings join with `;`."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, ArrayType) and f.dataType.elementType.simpleString() == "string":
            out.append(F.array_join(f.name, ";").alias(f.name))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            out.append(F.to_json(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(out)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    if kind == "csv":
        flat(df).write.mode(mode).option("header", True).csv(path)
    elif kind in ("json", "parquet"):
        getattr(df.write.mode(mode), kind)(path)
    else:
        raise ValueError(f"no sink {kind!r}")


def markdown(df: DataFrame, rows: int = 50) -> str:
    """The first `rows` rows as a Markdown table, for reports."""
    head = flat(df).limit(rows).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in head])
