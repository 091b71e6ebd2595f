"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated and split into BLOCKS blocks. Two vectors whose squared distance is within the budget 2 - 2 * cosine
are, in some block, within that block's proportional share of it. Rotated coordinates are rounded to bytes, with each block's
share widened by the rounding, so that "within the share" is a test of integers that any task answers alike. The rotation
comes from a bounded sample (SAMPLE rows): principal axes, dealt so that each block leads with a wide one.

Each block is range-joined along its first coordinate in strips: a vector is indexed in its strip, and probes the next one
where that is in reach. A strip is cut into chunks of about CHUNK rows, and the rows to compare stream past each chunk, so no
task holds a hot strip. Only bytes travel here. Pairs within their block's share, and in no earlier block's, name the rows
that a second pass fetches whole to verify the pairs in double precision, comparison by comparison: no list of pairs is
ever sent. Links are counted, and only spanning edges go on.

Equal vectors of a label are one weighted node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm import common as C
from barograph.llm.components import components

COSINE = 0.93
BLOCKS = 4
CHUNK = 2048
#: Rows that are compared with a chunk at once.
BATCH = 512
#: Rows that the rotation is learned from, at most; it steers which pairs meet early, never which are found.
SAMPLE = 4096
#: Unit coordinates are rounded to multiples of 1 / SCALE.
SCALE = 127
#: Links of a comparison up to this many are all sent as edges; more are first reduced to spanning ones.
FEW = 500


def list_matrix(column: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    """The chosen rows of a list column, all of length `width`, as doubles."""
    flat = column.take(pa.array(rows)).flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), width)


def usable(column: pa.Array) -> np.ndarray:
    """Rows of a list column that are not null and not empty and hold neither nulls nor non-finite numbers."""
    import pyarrow.compute as pc

    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    flat = column.flatten()
    good = np.isfinite(np.asarray(pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)))
    count = np.concatenate([[0], np.cumsum(good)])
    end = np.cumsum(length)
    return (length > 0) & (count[end] - count[end - length] == length)


def rotation(width: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(20240229).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def learn_rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """Rotations to principal axes, widest first and dealt in turn to the blocks, by width of the vectors of a sample."""
    sample = rows.select("rid", "embedding").orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE)
    table = sample.select("embedding").toArrow()
    out: dict[int, np.ndarray] = {}
    column = table.column("embedding").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    good = usable(column) if len(column) else np.zeros(0, bool)
    length = np.array([len(v) if v is not None else 0 for v in column.to_pylist()], np.int64) if len(column) else np.zeros(0, np.int64)
    for width in np.unique(length[good]).tolist():
        x = list_matrix(column, np.flatnonzero(good & (length == width)), width)
        x = unit_rows(x[x.any(axis=1)])
        if len(x) >= 2 * width:
            _, axes = np.linalg.eigh(x.T @ x)
            axes = axes[:, ::-1]
            blocks = min(BLOCKS, width)
            out[width] = np.ascontiguousarray(axes[:, np.concatenate([np.arange(k, width, blocks) for k in range(blocks)])])
    return out


def block_columns(width: int) -> list[np.ndarray]:
    blocks = min(BLOCKS, width)
    sizes = [len(range(k, width, blocks)) for k in range(blocks)]
    return np.split(np.arange(width), np.cumsum(sizes)[:-1])


def reach(width: int, columns: int, cosine: float) -> int:
    """The largest squared distance of rounded block coordinates of two vectors within the block's share of the budget: each
    coordinate's difference is off by at most 1."""
    share = (2 - 2 * cosine) * columns / width
    return int((SCALE * np.sqrt(share) + np.sqrt(columns) + 1e-6) ** 2)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def marks(rows: DataFrame, rotations: dict[int, np.ndarray]) -> DataFrame:
    """(rid, label, width, h1, h2, bytes) of rows that may link: a digest of the vector, and its rounded rotated coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            length = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
            good = usable(column)
            for width in np.unique(length[good]).tolist():
                some = np.flatnonzero(good & (length == width))
                x = list_matrix(column, some, width)
                some, x = some[x.any(axis=1)], x[x.any(axis=1)] + 0.0  # -0 equals 0
                if not len(some):
                    continue
                turn = rotations.get(width)
                q = np.rint(unit_rows(x) @ (rotation(width) if turn is None else turn) * SCALE).astype(np.int8)
                digests = np.frombuffer(b"".join(hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x), np.int64).reshape(-1, 2)
                part = batch.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([
                    part.column("rid"), part.column("label"), pa.array(np.full(len(some), width, np.int32)), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()),
                    pa.array([v.tobytes() for v in q], pa.binary()),
                ], ["rid", "label", "width", "h1", "h2", "bytes"])

    label = rows.schema["label"].dataType.simpleString()
    fit = rows.where("label is not null and embedding is not null and vec_id is not null").select("rid", "label", "embedding")
    return fit.mapInArrow(C.tidy(run), f"rid long, label {label}, width int, h1 long, h2 long, bytes binary")


def strips(nodes: DataFrame, cosine: float) -> DataFrame:
    """(label, width, block, strip, beyond, node, bytes): each node once in its strip of every block, and once more, as
    `beyond`, in the next strip where that is in reach."""
    label = nodes.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                part = batch.take(pa.array(np.flatnonzero(widths == width)))
                q = coordinates(part.column("bytes"), width)
                for k, columns in enumerate(block_columns(width)):
                    far = int(np.sqrt(reach(width, len(columns), cosine))) + 1
                    wide = 2 * far
                    strip, inside = np.divmod(q[:, columns[0]].astype(np.int64), wide)
                    for beyond, rows in ((False, np.arange(len(q))), (True, np.flatnonzero(inside + far >= wide))):
                        n = len(rows)
                        some = part.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([
                            some.column("label"), pa.array(np.full(n, width, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(strip[rows] + beyond),
                            pa.array(np.full(n, beyond)), some.column("node"), some.column("bytes"),
                        ], ["label", "width", "block", "strip", "beyond", "node", "bytes"])

    return nodes.select("label", "width", "node", "bytes").mapInArrow(C.tidy(run), f"label {label}, width int, block int, strip long, beyond boolean, node long, bytes binary")


def coordinates(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, width)


def near_pairs(p: np.ndarray, index: np.ndarray, block: int, width: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(probe, index) pairs of rounded rows within their share in `block` and in no earlier one. All sums are integers below
    2**24, so float32 holds them."""
    columns = block_columns(width)
    a, b = (x[:, columns[block]].astype(np.float32) for x in (p, index))
    gap = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    j, i = np.nonzero(gap <= reach(width, len(columns[block]), cosine))
    for earlier in columns[:block]:
        fresh = np.ones(len(j), bool)
        for lo in range(0, len(j), 200_000):
            s = slice(lo, lo + 200_000)
            away = p[j[s]][:, earlier].astype(np.int32) - index[i[s]][:, earlier]
            fresh[s] = (away * away).sum(axis=1) > reach(width, len(earlier), cosine)
        j, i = j[fresh], i[fresh]
    return j, i


JOB = "key long, batch int, block int, probe boolean, own boolean, node long"


def meet(rows: DataFrame, cosine: float) -> DataFrame:
    """(key, batch, block, probe, own, node): the rows of each comparison that have a pair to verify. `own` comparisons are
    those of a chunk with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index, number = None, [], None, 0

        def compare(p: np.ndarray, nodes: np.ndarray, own: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number
            j, i = near_pairs(p, index["q"], index["block"], index["width"], cosine)
            if own:
                later = nodes[j] > index["node"][i]
                j, i = j[later], i[later]
            number += 1
            if len(j):
                probes, others = nodes[np.unique(j)], index["node"][np.unique(i)]
                n = len(probes) + len(others)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, key, np.int64)), pa.array(np.full(n, number, np.int32)), pa.array(np.full(n, index["block"], np.int32)),
                    pa.array(np.arange(n) < len(probes)), pa.array(np.full(n, own)), pa.array(np.concatenate([probes, others])),
                ], ["key", "batch", "block", "probe", "own", "node"])

        def close() -> Iterator[pa.RecordBatch]:
            """The chunk is whole: compare it with itself."""
            nonlocal held, index
            if not held:
                return
            index = {"q": np.concatenate([h[0] for h in held]), "node": np.concatenate([h[1] for h in held]), "block": held[0][2], "width": held[0][3]}
            held = []
            for lo in range(0, len(index["node"]), BATCH):
                yield from compare(index["q"][lo : lo + BATCH], index["node"][lo : lo + BATCH], True)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, probe = batch.column("key").to_numpy(), batch.column("probe").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (probe[1:] != probe[:-1])))
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)], strict=True):
                part = batch.slice(lo, hi - lo)
                if keys[lo] != key:
                    yield from close()
                    key, held, index, number = int(keys[lo]), [], None, 0
                block, width = part.column("block")[0].as_py(), part.column("width")[0].as_py()
                q, nodes = coordinates(part.column("bytes"), width), part.column("node").to_numpy()
                if not probe[lo]:
                    held.append((q, nodes, block, width))
                    continue
                yield from close()
                for at in range(0, hi - lo, BATCH) if index is not None else ():
                    yield from compare(q[at : at + BATCH], nodes[at : at + BATCH], False)
        yield from close()

    n = C.shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, "key").sortWithinPartitions("key", "probe", "node").select("key", "probe", "block", "width", "node", "bytes").mapInArrow(C.tidy(run), JOB)


def spanning(linked: np.ndarray, index: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links (probe x index) connect."""
    if linked.sum() <= FEW:
        j, i = np.nonzero(linked)
        return probe[j], index[i]
    label = np.arange(len(index))
    while True:
        row = np.where(linked, label, len(index)).min(axis=1)
        new = np.minimum(label, np.where(linked, row[:, None], len(index)).min(axis=0))
        if (new == label).all():
            break
        label = new
    j = np.flatnonzero(row < len(index))
    i = np.flatnonzero(label != np.arange(len(index)))
    return np.concatenate([probe[j], index[i]]), np.concatenate([index[row[j]], index[label[i]]])


def verify(rows: DataFrame, cosine: float) -> DataFrame:
    """(a, b, links) of whole comparisons: links of node a counted (b null), and spanning edges (a, b)."""

    def out(a, b, links) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, pa.array(links, pa.int64())], ["a", "b", "links"])

    def settle(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        width, block, own = (t.column(c)[0].as_py() for c in ("width", "block", "own"))
        q = coordinates(t.column("bytes"), width)
        column = t.column("embedding").chunk(0)
        x = unit_rows(list_matrix(column, np.arange(t.num_rows), width) + 0.0)
        probe, node, weight = (t.column(c).to_numpy() for c in ("probe", "node", "weight"))
        p, i = np.flatnonzero(probe), np.flatnonzero(~probe)
        a, b = near_pairs(q[p], q[i], block, width, cosine)
        if own:
            later = node[p[a]] > node[i[b]]
            a, b = a[later], b[later]
        linked = np.zeros((len(p), len(i)), bool)
        for lo in range(0, len(a), 100_000):
            s = slice(lo, lo + 100_000)
            linked[a[s], b[s]] = np.einsum("ij,ij->i", x[p[a[s]]], x[i[b[s]]]) >= cosine
        for side, others, counts in ((p, i, linked @ weight[i]), (i, p, linked.T @ weight[p])):
            some = np.flatnonzero(counts)
            if len(some):
                yield out(node[side[some]], pa.nulls(len(some), pa.int64()), counts[some])
        if linked.any():
            a, b = spanning(linked, node[i], node[p])
            yield out(a, pa.array(b, pa.int64()), np.zeros(len(a), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_job, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, numbers = batch.column("key").to_numpy(), batch.column("batch").to_numpy()
            cut = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (numbers[1:] != numbers[:-1])))
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)], strict=True):
                if (keys[lo], numbers[lo]) != open_job:
                    if held:
                        yield from settle(held)
                    open_job, held = (keys[lo], numbers[lo]), []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from settle(held)

    n = C.shuffle_partitions(rows.sparkSession)
    rows = rows.select("key", "batch", "block", "probe", "own", "node", "weight", "width", "bytes", "embedding")
    return rows.repartition(n, "key", "batch").sortWithinPartitions("key", "batch").mapInArrow(C.tidy(run), "a long, b long, links long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label).

    Rows of equal, not null label link when the cosine of their vectors is at least `cosine` (> 0), in double precision; vectors of
    different length, null or empty ones, zero ones and such that hold nulls or non-finite numbers link with nothing. Rows
    that repeat a vec_id are rows of their own and share its component; rows with a null vec_id link with nothing. Other
    columns are not used; an empty input gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    single = rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1 or vec_id is null").isEmpty()
    rows = rows.withColumn("rid", F.col("vec_id")) if single else C.stash(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
    found = C.stash(marks(rows, learn_rotations(rows)), "marks")
    same = ["label", "width", "h1", "h2"]
    twins = C.stash(found.groupBy(*same).agg(F.min("rid").alias("node"), F.count("*").alias("weight")).where("weight > 1"), "twins")
    twin = found.select("rid", *same).join(twins, same).select("rid", "node", "weight")
    own = found.select("rid", "label", "width", "bytes").join(twin, "rid", "left")
    own = own.withColumns({"node": F.coalesce("node", "rid"), "weight": F.coalesce("weight", F.lit(1))})
    own = C.stash(own.withColumn("bytes", F.when(F.col("rid") == F.col("node"), F.col("bytes"))), "own")
    nodes = own.where("rid = node").drop("rid")

    strip = ["label", "width", "block", "strip"]
    dealt = strips(nodes, cosine)
    big = dealt.where("not beyond").groupBy(*strip).agg(F.ceil(F.count("*") / CHUNK).alias("chunks")).where("chunks > 1")
    dealt = dealt.join(big, strip, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    home = F.when(F.col("beyond"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("node"), "chunks"))
    dealt = dealt.withColumn("home", home.cast("long")).withColumn("chunk", F.explode(F.sequence(F.greatest("home", F.lit(0).cast("long")), F.col("chunks") - 1)))  # later chunks are probed
    dealt = dealt.withColumn("probe", F.col("chunk") != F.col("home")).withColumn("key", F.xxhash64(*strip, "chunk"))
    jobs = C.stash(meet(dealt, cosine), "jobs")
    asked = jobs.join(nodes.select("node", "weight", "width", "bytes"), "node").join(rows.select(F.col("rid").alias("node"), "embedding"), "node")
    links = C.stash(verify(asked, cosine), "links")

    labels = components(links.where("b is not null").select("a", "b"))
    counts = links.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    known = own.select("rid", "node", "weight").join(counts, F.col("node") == F.col("a"), "left").join(labels, "node", "left")
    known = known.select("rid", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    done = rows.select("rid", "vec_id").join(known, "rid", "left")
    if single:
        done = done.withColumn("component_id", F.coalesce("component", "vec_id"))
    else:
        least = done.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("least"))
        done = done.join(least, "component", "left").withColumn("component_id", F.coalesce("least", "vec_id"))
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(C.table(spark, sf_dir, "embeddings"), COSINE)


OP6_SQL = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
r as (select vec_id as a, vec_id as c from embeddings union select l.b, r.c from r join l on l.a = r.a)
select v.vec_id, (select count(*) from l where l.a = v.vec_id) as n_links, m.c as component_id, v.vec_id = m.c as kept
from v join (select a, min(c) as c from r group by a) m on m.a = v.vec_id
"""
