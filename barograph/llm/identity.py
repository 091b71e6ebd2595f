"""Internal document numbers that keep the order of doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.llm import common as C


def text_hash() -> Column:
    """Digest of the text, which tells null from empty."""
    return F.md5(F.encode(F.coalesce(F.concat(F.lit("t"), F.col("text").cast("string")), F.lit("")), "UTF-8"))


def unique(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("doc_id").isNull() | (F.col("n") > 1)).isEmpty()


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows, names): rows has _d (a long, unique per document, in the order of doc_id) and text.

    Usually _d is doc_id and names is None. Where doc_ids are null or repeated, rows equal in doc_id and text become one
    document, differing ones are told apart (null doc_id first, then by a hash of the text), and names maps _d to
    (doc_id, _h, _copies): its text_hash() and the number of input rows it stands for.
    """
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if unique(x):
        return x.select(F.col("doc_id").alias("_d"), "text"), None
    x = x.withColumn("_h", text_hash())
    names = x.groupBy("doc_id", "_h").agg(F.count("*").alias("_copies")).orderBy("doc_id", "_h")
    names = C.stash(names.withColumn("_d", F.monotonically_increasing_id()), "names")
    one = x.groupBy("doc_id", "_h").agg(F.first("text").alias("text"))
    rows = one.join(names, one["doc_id"].eqNullSafe(names["doc_id"]) & (one["_h"] == names["_h"])).select("_d", "text")
    return C.stash(rows, "numbered"), names.select("_d", "doc_id", "_h", "_copies")


def named(result: DataFrame, names: DataFrame | None, others: tuple[str, ...] = ()) -> DataFrame:
    """Turns _d, and the _d's in columns `others`, back into doc_ids; repeated rows come back as often as they came in."""
    columns = ["doc_id", *(c for c in result.columns if c != "_d")]
    if names is None:
        return result.withColumnRenamed("_d", "doc_id").select(columns)
    for c in others:
        result = result.join(names.select(F.col("_d").alias(c), F.col("doc_id").alias("_to")), c, "left").drop(c).withColumnRenamed("_to", c)
    return result.join(names, "_d").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(columns)
