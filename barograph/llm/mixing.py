"""Mixing sources to target weights, with DataFrame functions only.

Each document gets a hash-random key; within its source documents are range-sorted by key; prefix sums of sizes come in two
levels (inside key ranges, then over the ranges' totals), so no task holds a source; each source is cut at its exact budget,
after as many whole epochs as the budget holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.llm import common as C

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Rank of a document in its source: the first 52 bits of a digest of its doc_id.
KEY_BITS = 52


def size_of(text: Column) -> Column:
    """Words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(*columns: Column) -> Column:
    digest = F.md5(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Adds `target` to one row per source (source, source_size).

    Sources in code point order, null last, weigh `weights` in turn and share the total of all sizes; a source takes at most
    `most_epochs` times its size and the excess goes to the others by weight: with sources in order of cap by weight, the
    first k are capped, where k is the least number after which the share of the next stays below its cap.
    """
    n = len(weights)
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(n))
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double")
    x = sources.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most_epochs)))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(so_far), F.lit(0.0))
    rest = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(so_far), F.lit(0.0))
    x = x.withColumn("_level", left / rest)
    # The first source whose share stays within its cap sets the level; the levels of later ones are lower.
    level = F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(everything)
    target = F.least(F.col("_cap"), F.coalesce(level * F.col("_w"), F.col("_cap")))
    return x.withColumn("target", target).drop("_w", "_cap", "_level")


def mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS, whole: bool = False) -> DataFrame:
    """Adds source_size, target and taken (words that the mix takes) to rows (doc_id, source, size, _key); drops _key.

    A document is taken once for each whole epoch of its source's budget and, in key order, once more until the rest is used
    up. `whole` cuts at the document nearest to the budget, else the one document on the edge is cut at the exact word.
    Null sources form one source. Empty documents are taken 0 words. An empty input gives an empty result. Rows with equal
    keys (repeated rows) take the order of size, all else being equal. `sized` is read three times: hand in a written table.
    """
    tag = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))  # null-safe join key
    x = sized.withColumn("_tag", tag)
    sources = x.groupBy("_tag").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    goal = targets(sources, weights, most_epochs).withColumn("_ranges", F.ceil(F.sqrt("_rows")).cast("long"))
    # One narrow row per source; the join deals rows of a hot source by range as well, see `salted`.
    x = x.join(F.broadcast(goal.drop("source", "_rows")) if _few(goal) else goal.drop("source", "_rows"), "_tag")
    x = x.withColumn("_range", F.floor(F.col("_key").cast("double") / F.lit(float(1 << KEY_BITS)) * F.col("_ranges")).cast("long"))
    totals = x.groupBy("_tag", "_range").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("_tag").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_tag", "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_tag", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(totals, ["_tag", "_range"])
    begin = F.col("_at") + F.col("_before")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    if whole:
        part = F.when(begin + F.col("size") / 2 <= budget, F.col("size")).otherwise(F.lit(0))
    else:
        part = F.greatest(F.lit(0), F.least(F.col("size"), budget - begin))
    x = x.withColumn("taken", F.when(epochs >= most_epochs, F.col("size") * most_epochs).otherwise(epochs * F.col("size") + part).cast("long"))
    return x.drop("_tag", "_range", "_ranges", "_at", "_before", "_key")


#: Sources up to this many are broadcast to the rows; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def _few(goal: DataFrame) -> bool:
    return goal.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS, whole: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs; see mix()."""
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), key_of(F.col("doc_id")).alias("_key"))
    return mix(C.stash(sized, "sizes"), weights, most_epochs, whole)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(C.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(doc_id::varchar), 1, 13))::bigint as k from documents),
s as (select source, sum(size)::bigint as source_size, (case (row_number() over (order by encode(source) nulls last) - 1) % 3
        when 0 then 5.0 when 1 then 2.0 else 1.0 end)::double as w from d group by source),
c as (select *, source_size * 3.0::double as cap from s),
l as (select *, ((sum(source_size) over ())::double - coalesce(sum(cap) over p, 0.0)) / ((sum(w) over ()) - coalesce(sum(w) over p, 0.0)) as level
      from c window p as (order by cap / w, encode(source) nulls last rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, least(cap, coalesce((select max(level) from l where level * w <= cap) * w, cap)) as target from l),
b as (select d.doc_id, d.size, t.source_size, t.target,
        coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id rows between unbounded preceding and 1 preceding), 0) as begins,
        case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as epochs
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (case when epochs >= 3 then size * 3 else epochs * size + greatest(0, least(size, round(target - epochs * source_size) - begins)) end)::bigint as taken from b
"""
