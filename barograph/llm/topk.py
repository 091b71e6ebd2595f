"""Exact top-k search by inner product with an impact-ordered, score-at-a-time index.

Candidates are dealt into shards. In a shard, postings (row, dimension, value) are put into segments by their quantised impact
|value|, largest first. A sparse segment holds posting lists by dimension, which are added up by row; one that holds a good
part of all (row, dimension) places holds them as one block, which is added up by one product. All queries of a batch add
up one segment after the other; what the segments still to come can add to a score is at most the query's norm times the
norm of the row's values in them. A query stops only on proof that the rows still possible are few: those whose upper bound
reaches the k-th best lower bound. These are rescored exactly, in integers.

Sums are kept in single precision, with the rounding in the bounds, so that a shard costs less than its exact scores would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.llm import common as C
from barograph.llm.vectors import list_matrix, usable

#: Rows of a shard, about.
SHARD = 8192
#: Shares of all postings that the segments end at, in the order of impact.
SHARES = (0.02, 0.75, 1.0)
#: Impact levels that values are quantised to.
LEVELS = 256
#: A segment that fills at least this share of all places is held as a block.
FULL = 0.1
#: Proofs are tried once the segments to come hold at most this share of the squared norms.
PROVE = 0.1
BATCH = 256
#: A query stops when at most this share of the shard is still possible (or `k` rows).
POSSIBLE = 0.02
SCALE = 256.0
#: Values below this are split into two limbs for exact sums in longs; greater ones are summed as Python integers.
LIMB = 1 << 26


class Postings:
    """The postings of one segment: lists by dimension, or one block."""

    def __init__(self, values: np.ndarray, chosen: np.ndarray):
        rows, dims = values.shape
        self.block = None
        if chosen.sum() >= FULL * rows * dims:
            self.block = np.where(chosen, values, np.float32(0))
            return
        dim, row = np.nonzero(chosen.T)
        ends = np.searchsorted(dim, np.arange(dims + 1)).tolist()
        self.lists = [(d, row[lo:hi], values[row[lo:hi], d, None]) for d, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if hi > lo]

    def add(self, score: np.ndarray, queries: np.ndarray) -> None:
        """Adds the segment to score (row, query) for queries (dimension, query)."""
        if self.block is not None:
            score += self.block @ queries
            return
        for dim, rows, values in self.lists:
            score[rows] += values * queries[dim]


class Shard:
    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        size = np.abs(values)
        self.top = max(float(size.max(initial=0)), 1.0)
        small = values / self.top
        self.norm = np.sqrt((small * small).sum(axis=1))
        level = np.minimum((size / self.top * LEVELS).astype(np.int64), LEVELS - 1)
        mass = np.cumsum(np.bincount(level.ravel(), minlength=LEVELS)[::-1])[::-1]  # postings at this level or above
        edges = [LEVELS]
        for share in SHARES[:-1]:
            edges.append(min(int(np.searchsorted(-mass, -share * mass[0], "right")), edges[-1]))
        edges.append(0)
        self.segments: list[tuple[Postings, np.ndarray]] = []
        for high, low in zip(edges[:-1], edges[1:], strict=True):
            if high > low:
                rest = np.where(level < low, small, 0.0)
                self.segments.append((Postings(small.astype(np.float32), (level >= low) & (level < high)), np.sqrt((rest * rest).sum(axis=1))))

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, row number, score) of the k best rows of each query, its own row left out; ties to smaller ids."""
        rows, dims = self.values.shape
        largest = np.maximum(np.abs(queries).max(axis=1, initial=0, keepdims=True), 1.0)
        small = queries / largest
        norm = np.sqrt((small * small).sum(axis=1)).astype(np.float32) * np.float32(1 + 1e-6)
        small = np.ascontiguousarray(small.T.astype(np.float32))
        every = (self.norm * self.norm).sum()
        rounding = (2 * dims + 8) * 2.0**-23 * self.norm  # of sums in single precision, by the query's norm
        by_id = np.argsort(self.ids, kind="stable")
        place = by_id[np.minimum(np.searchsorted(self.ids[by_id], query_ids), rows - 1)]
        has_own = self.ids[place] == query_ids
        active = np.arange(len(queries))
        score = np.zeros((rows, len(queries)), np.float32)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for n, (segment, rest) in enumerate(self.segments):
            last = n == len(self.segments) - 1
            segment.add(score, small[:, active])
            if not last and (rest * rest).sum() > PROVE * every:
                continue
            score[place[active[has_own[active]]], np.flatnonzero(has_own[active])] = -np.inf
            slack = (rest * (1 + 1e-6) + rounding).astype(np.float32)[:, None] * norm[active] + np.float32(1e-37)
            low = score - slack
            np.add(score, slack, out=slack)  # now the upper bounds
            possible = slack >= kth_best(low, k)
            possible[place[active[has_own[active]]], np.flatnonzero(has_own[active])] = False
            stop = possible.sum(axis=0) <= max(k, POSSIBLE * rows)
            if last:
                stop[:] = True
            r, q = np.divmod(np.flatnonzero(possible), len(active))
            done = stop[q]
            out.append((active[q[done]], r[done]))
            active, score = active[~stop], score[:, ~stop]
            if not len(active):
                break
        q, r = (np.concatenate(x) for x in zip(*out, strict=True))
        high, low, found = exact_products(queries, self.values, q, r)
        order = np.lexsort((self.ids[r], -low, -high, q))
        q, r = q[order], r[order]
        begin = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        first = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q)))) < k
        return q[first], r[first], found[order][first]


def kth_best(low: np.ndarray, k: int) -> np.ndarray:
    """A bound that k rows of each column of `low` reach: the k-th greatest of the greatest in each of many parts of the rows."""
    rows = len(low)
    if rows <= k:
        return np.full(low.shape[1], -np.inf, np.float32)
    parts = max(k, min(rows // 8, 16 * k))
    each = rows // parts
    tops = low[: each * parts].reshape(each, parts, -1).max(axis=0)
    return np.partition(tops, parts - k, axis=0)[parts - k]


def exact_products(queries: np.ndarray, values: np.ndarray, q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact inner products of queries[q] and values[r], integers held as doubles, as (high, low, score): they sort by high, then
    low, and score is the product cut to the range of longs."""
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    largest, dims = max(float(np.abs(queries).max(initial=0)), float(np.abs(values).max(initial=0))), queries.shape[1]
    if largest >= LIMB * LIMB or (dims >= 1 << 9 and largest * largest * dims >= 2.0**62):  # beyond what longs can sum
        wide = [sum(int(a) * int(b) for a, b in zip(queries[i], values[j], strict=True)) for i, j in zip(q.tolist(), r.tolist(), strict=True)]
        rank = {w: n for n, w in enumerate(sorted(set(wide)))}
        return np.array([rank[w] for w in wide], np.int64), np.zeros(len(wide), np.int64), np.array([max(least, min(most, w)) for w in wide], np.int64)
    high, low, score = (np.zeros(len(q), np.int64) for _ in range(3))
    for at in range(0, len(q), 20_000):
        s = slice(at, at + 20_000)
        a, b = queries[q[s]].astype(np.int64), values[r[s]].astype(np.int64)
        if largest * largest * dims < 2.0**62:
            high[s] = score[s] = (a * b).sum(axis=1)
            continue
        (a1, a0), (b1, b0) = np.divmod(a, LIMB), np.divmod(b, LIMB)
        middle = (a0 * b1).sum(axis=1) + (a1 * b0).sum(axis=1)
        units = (a0 * b0).sum(axis=1)
        middle += units // LIMB
        high[s], low[s] = (a1 * b1).sum(axis=1) + middle // LIMB, (middle % LIMB) * LIMB + units % LIMB
        cut = np.clip(high[s], -(1 << 11), (1 << 11) - 1) * (1 << 52) + low[s]
        score[s] = np.where(high[s] >= 1 << 11, most, np.where(high[s] < -(1 << 11), least, cut))
    return high, low, score


def quantised(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, width, vec): floor(scale * x) of the usable vectors, as the bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            good = usable(column) & batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            length = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
            for width in np.unique(length[good]).tolist():
                rows = np.flatnonzero(good & (length == width))
                x = np.floor(scale * list_matrix(column, rows, width))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(np.full(len(rows), width, np.int32)), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "width", "vec"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").where("embedding is not null").mapInArrow(C.tidy(run), "vec_id long, width int, vec binary")


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of (vec_id, embedding) that `is_query` (a condition on vec_id) holds for,
    the k rows of highest integer inner product, ties to the smaller vec_id.

    Vectors null, empty, or with null or non-finite components take no part, nor do rows with a null vec_id; vectors of
    different length do not meet; a query never finds rows with its own vec_id. Of rows that repeat a vec_id, equal ones
    count once and of differing ones the first by bytes counts. Scores beyond a long are cut to its range. An empty
    input gives an empty result.

    Queries are copied to every shard, as a search of all rows by a share of them needs; each shard streams them past its index.
    """
    flat = quantised(vectors, scale).groupBy("vec_id").agg(F.min(F.struct("vec", "width")).alias("v"))
    flat = C.stash(flat.select("vec_id", "v.vec", "v.width"), "quantised")
    shards = max(1, -(-flat.count() // SHARD))
    spark = vectors.sparkSession
    index = flat.select("vec_id", "width", "vec", F.lit(0).cast("byte").alias("side"), F.pmod(F.xxhash64("vec_id"), F.lit(shards).cast("long")).alias("shard"))
    asked = flat.where(is_query).select("vec_id", "width", "vec", F.lit(1).cast("byte").alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shard = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            shards_, widths, sides = (batch.column(c).to_numpy() for c in ("shard", "width", "side"))
            cut = np.flatnonzero(np.append(True, (shards_[1:] != shards_[:-1]) | (widths[1:] != widths[:-1]) | (sides[1:] != sides[:-1])))
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(sides)], strict=True):
                part, width = batch.slice(lo, hi - lo), int(widths[lo])
                ids = part.column("vec_id").to_numpy()
                x = np.frombuffer(b"".join(part.column("vec").to_pylist()), np.float64).reshape(-1, width)
                if (shards_[lo], width) != key:
                    key, held, shard = (shards_[lo], width), [], None
                if sides[lo] == 0:
                    held.append((ids, x))
                    continue
                if shard is None:
                    if not held:
                        continue
                    shard = Shard(*(np.concatenate(v) for v in zip(*held, strict=True)))
                for at in range(0, hi - lo, BATCH):
                    q, r, score = shard.search(x[at : at + BATCH], ids[at : at + BATCH], k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + BATCH][q]), pa.array(shard.ids[r]), pa.array(score)], ["query_id", "vec_id", "score"])

    n = C.shuffle_partitions(spark)
    rows = index.unionByName(asked).repartition(n, "shard", "width").sortWithinPartitions("shard", "width", "side")
    found = rows.mapInArrow(C.tidy(run), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP5_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""
