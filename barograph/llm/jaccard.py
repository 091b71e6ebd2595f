"""N-gram Jaccard join by parity sketches.

A document's shingles are dealt by hash to the segments of a sketch, and each segment is the exclusive or of its shingles' hashes
(a wide bit segment in which every shingle flips bits). A shingle that two documents do not share touches one segment, so the
number of segments that differ is at most the symmetric difference. Documents that link have a symmetric difference of at most
(1 - t) / (1 + t) times the sum of their sizes; per band of sizes a sketch has twice as many segments as that, so linked documents
agree in more than half (pigeonhole), and each need only send the half that is least likely to be shared by chance (see
segment_keys). Segments are joined by equality, and candidates are verified on their whole shingle sets.

Exact copies of a text are one node. In a segment that many documents share, all are compared with the first; where that leaves
several components, further pairs are taken. Before texts are fetched, pairs must pass their parity sketches: bit sketches whose
Hamming distance is at most the symmetric difference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm import common as C
from barograph.llm.components import components
from barograph.llm.identity import named, numbered

#: Segments with up to this many documents compare all pairs at once.
SMALL = 6
#: Documents of a shared segment that others stream past, in a second look.
CHUNK = 1024
#: One document in SCAN is looked at for frequent segments: those in more than FREQUENT of them.
SCAN, FREQUENT = 16, 0.0005
#: Frequent segments that tasks are told of, at most.
MOST = 500_000
#: Parts that the documents of a segment are dealt into where they meet what is known of the segment.
SALTS = 16
#: Pairs of one document that are verified in one unit.
UNIT = 48
_U = np.uint64


class Rule:
    """Shingle length, and links as den * intersection >= num * union."""

    def __init__(self, words: int, num: int, den: int = 100):
        self.words, self.num, self.den = words, num, den

    def links(self, both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.den * both >= self.num * (a + b - both)) & (both > 0)

    def reach(self, total):
        """The largest symmetric difference of two linked sets whose sizes sum to `total`."""
        return (self.den - self.num) * total // (self.den + self.num)

    def bands(self, most: int) -> np.ndarray:
        """Lower edges of the size bands: the partners of a size lie in its own band or the next ones."""
        edges = [1]
        while edges[-1] <= most:
            edges.append(max(edges[-1] + 1, edges[-1] * self.den // self.num))
        return np.array(edges, np.int64)


def shingles(buf: np.ndarray, offs: np.ndarray, words: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of all rows, sorted. Rows with fewer words have their whole sequence as one."""
    row, hashes = all_shingles(buf, offs, words, (salt,))
    return _distinct(row, hashes[0])


def _distinct(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[fresh], hashes[fresh]


def all_shingles(buf: np.ndarray, offs: np.ndarray, words: int, salts: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row, hashes) of the shingles of all rows in the order of the text, one array of hashes for each salt."""
    start, end, row = C.words(buf, offs)
    if not len(start):
        return row, [row.astype(np.uint64) for _ in salts]
    low = C.lowered(buf)
    view = C.lanes(low)
    n, m = len(offs) - 1, len(start)
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    length = np.minimum(count, words)
    left = (first + count)[row] - np.arange(m)  # words from here to the end of the row
    full = (left >= words) | ((count[row] < words) & (left == count[row]))
    out = []
    for salt in salts:
        one = C.span_digests(view, low, start, end, salt)
        hashes = C.mix(one)  # so that the order of words counts
        for i in range(1, words):
            inside = np.flatnonzero(left > i)
            part = np.zeros(m, np.uint64)
            part[inside] = one[inside + i]
            hashes = C.mix(hashes + part)
        out.append(C.mix(hashes + length[row].astype(np.uint64))[full])
    return row[full], out


def checked_shingles(buf: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, second hash) of the distinct shingles, sorted by row and hash: two shingles are the same when both agree."""
    row, (hashes, second) = all_shingles(buf, offs, words, (0, 1))
    order = np.lexsort((hashes, row))
    row, hashes, second = row[order], hashes[order], second[order]
    near = (row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1])
    if (near & (second[1:] != second[:-1])).any():  # shingles that collide in the first hash
        order = np.lexsort((second, hashes, row))
        row, hashes, second = row[order], hashes[order], second[order]
        near = (row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1]) & (second[1:] == second[:-1])
    fresh = np.append(True, ~near) if len(row) else np.ones(0, bool)
    return row[fresh], hashes[fresh], second[fresh]


def shared_shingles(mine: tuple[np.ndarray, np.ndarray], own: tuple[np.ndarray, np.ndarray]) -> int:
    """Shingles that two sets (hashes, second hashes), as of checked_shingles(), have in common."""
    if not len(mine[0]) or not len(own[0]):
        return 0
    at = np.minimum(np.searchsorted(mine[0], own[0]), len(mine[0]) - 1)
    equal = mine[0][at] == own[0]
    if equal.all() and len(own[0]) and (mine[1][at] == own[1]).all():
        return len(own[0])
    agreed = equal & (mine[1][at] == own[1])
    if (equal & ~agreed).any():  # a collision in the first hash: look at both
        return len(set(zip(mine[0].tolist(), mine[1].tolist(), strict=True)) & set(zip(own[0].tolist(), own[1].tolist(), strict=True)))
    return int(agreed.sum())


def largest_gap(rule: Rule, edges: np.ndarray, band: np.ndarray) -> np.ndarray:
    """The largest symmetric difference of linked sets of which the smaller lies in `band`."""
    top = edges[band + 1] - 1
    return rule.reach(top + top * rule.den // rule.num)


def segment_keys(rule: Rule, row: np.ndarray, hashes: np.ndarray, n: int, edges: np.ndarray, frequent: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the sketch segments of all rows, for every band in which the row may be the smaller or the larger set.

    A sketch has 2 * (gap + 1) segments, so linked sets agree in gap + 2 at least. Segments are put in an order that depends on
    their content only, and a row sends just the first gap + 1: of the segments that two linked sets agree in, the first by
    that order cannot be among the gap + 1 that either leaves out. Segments left out first are the empty ones, then those
    found frequent, then those with few shingles. `frequent` (sorted keys, ranks) only steers; None: send all segments.
    """
    size = np.bincount(row, minlength=n)
    own = np.searchsorted(edges, np.maximum(size, 1), "right") - 1
    lowest = np.searchsorted(edges, np.maximum(-(-size * rule.num // rule.den), 1), "right") - 1
    out_row, out_key = [], []
    for back in range(int((own - lowest).max()) + 1 if n else 0):
        band = own - back
        part = np.flatnonzero((size > 0) & (band >= lowest))
        if not len(part):
            continue
        send = np.zeros(n, np.int64)
        send[part] = largest_gap(rule, edges, band[part]) + 1
        segments = 2 * send
        base = np.cumsum(segments) - segments
        mine = segments[row] > 0
        r, h = row[mine], hashes[mine]
        salt = C.mix(h + _U(0x632BE59BD9B4E019))
        slot = base[r] + ((salt >> _U(11)) % segments[r].astype(np.uint64)).astype(np.int64)
        total = int(segments.sum())
        value = np.zeros(total, np.uint64)
        np.bitwise_xor.at(value, slot, h)
        count = np.bincount(slot, minlength=total)
        of = np.repeat(np.arange(n), segments)
        place = np.arange(total) - base[of]
        key = C.mix(value + C.mix((band[of].astype(np.uint64) << _U(32)) + place.astype(np.uint64) + (count > 0)))
        if frequent is not None:
            keys, ranks = frequent
            late = np.zeros(total, np.uint64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                late = np.where(keys[at] == key, ranks[at], 0).astype(np.uint64)
            late[count == 0] = 255
            rank = (late << _U(56)) | ((_U(255) - np.minimum(count, 255).astype(np.uint64)) << _U(48)) | (key >> _U(16))
            order = np.lexsort((rank, of))
            order = order[np.arange(total) - base[of] < send[of]]
            of, key = of[order], key[order]
        out_row.append(of)
        out_key.append(key)
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_row), np.concatenate(out_key)


def sketch_rows(docs: DataFrame, rule: Rule, frequent: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """(key, _d): a row for every sketch segment that every row (_d, text) sends."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = rule.bands(1 << 16)
        for batch in batches:
            for rows, buf, offs in C.text_chunks(batch):
                row, hashes = shingles(buf, offs, rule.words)
                n = rows.num_rows
                size = np.bincount(row, minlength=n)
                if len(row) and size.max() >= edges[-1] // 2:
                    edges = rule.bands(4 * int(size.max()))
                of, key = segment_keys(rule, row, hashes, n, edges, shared.value)
                doc = rows.column("_d").to_numpy()[of]
                for lo in range(0, len(of), 50_000):
                    s = slice(lo, lo + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(key[s].view(np.int64)), pa.array(doc[s])], ["key", "_d"])

    return docs.mapInArrow(C.tidy(run), "key long, _d long")


def frequent_segments(docs: DataFrame, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Segments in more than FREQUENT of some documents, the MOST most frequent, with ranks 1 to 254.

    They only change the order in which segments are sent; which documents are looked at changes no result.
    """
    some = docs.where(F.pmod(F.xxhash64("_d"), F.lit(SCAN)) == 0)
    least = max(3, FREQUENT * some.count())
    found = sketch_rows(some, rule, None).groupBy("key").count().where(F.col("count") >= least).orderBy(F.desc("count"), "key").limit(MOST).collect()
    keys = np.array([r["key"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(keys)
    ranks = np.minimum(np.log2(np.array([r["count"] for r in found], np.float64) + 1) * 8, 254)
    return keys[order], ranks.astype(np.uint64)[order]


def parity_bits(n: int) -> int:
    """Bits of the parity sketch of a set of n: at least 2 n, so that it still tells close sets apart. A power of two."""
    return 1 << max(9, min(20, (2 * n - 1).bit_length()))


def parity_sketch(hashes: np.ndarray) -> bytes:
    """Bit h mod size flips for every hash h: the Hamming distance of two sketches is at most the sets' symmetric difference."""
    size = parity_bits(len(hashes))
    odd = np.bincount((hashes & _U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> bytes:
    """The sketch of `size` bytes of the same set: positions modulo a smaller power of two."""
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = (int.from_bytes(sketch[:half], "little") ^ int.from_bytes(sketch[half:], "little")).to_bytes(half, "little")
    return sketch


def hamming(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    return (int.from_bytes(folded(a, size), "little") ^ int.from_bytes(folded(b, size), "little")).bit_count()


def may_link(rule: Rule, na, nb, distance):
    return (distance <= rule.reach(na + nb)) & (rule.den * np.minimum(na, nb) >= rule.num * np.maximum(na, nb))


def profiles(docs: DataFrame, rule: Rule) -> DataFrame:
    """(_d, n, sketch) of rows (_d, text): the number of distinct shingles and their parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offs in C.text_chunks(batch):
                row, hashes, _ = checked_shingles(buf, offs, rule.words)
                cut = np.searchsorted(row, np.arange(rows.num_rows + 1))
                sketches = [parity_sketch(hashes[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("_d"), pa.array(np.diff(cut)), pa.array(sketches, pa.binary())], ["_d", "n", "sketch"])

    return docs.mapInArrow(C.tidy(run), "_d long, n long, sketch binary")


def sketch_filter(pairs: DataFrame, profile: DataFrame, rule: Rule) -> DataFrame:
    """The distinct pairs (a, b, members) that their sizes and parity sketches allow to link."""
    side = lambda c: profile.select(F.col("_d").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    x = pairs.groupBy("a", "b").agg(F.max("members").alias("members")).join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = np.array([hamming(x, y) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)], np.int64)
            keep = may_link(rule, batch.column("na").to_numpy(), batch.column("nb").to_numpy(), far)
            yield batch.select(["a", "b", "members"]).filter(pa.array(keep))

    return x.where(rule.den * F.least("na", "nb") >= rule.num * F.greatest("na", "nb")).select("a", "b", "members", "na", "nb", "sa", "sb").mapInArrow(C.tidy(run), "a long, b long, members int")


def bucket_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, key, members): pairs of documents with a common segment. Segments with more than SMALL documents pair each with
    the first only, and keep their key for a second look."""

    def emit(a, b, key, members) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(key), pa.array(members.astype(np.int32))], ["a", "b", "key", "members"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []  # the first documents of the open segment
        open_key, count = None, 0

        def close() -> Iterator[pa.RecordBatch]:
            if 1 < count <= SMALL:
                pairs = [(x[0], y[0]) for i, x in enumerate(held) for y in held[i + 1 :]]
                a, b = np.array(pairs, np.int64).T
                yield emit(a, b, np.full(len(a), open_key, np.int64), np.zeros(len(a)))

        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc = batch.column("key").to_numpy(), batch.column("_d").to_numpy()
            cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(cut, len(key)))
            # Whole segments inside the batch, all at once; the first and the last may go on in other batches.
            inner = np.zeros(len(cut), bool)
            inner[1:-1] = True
            inside = cut[inner & (size > 1) & (size <= SMALL)], size[inner & (size > 1) & (size <= SMALL)]
            for i in range(SMALL - 1):
                for j in range(i + 1, SMALL):
                    at = inside[0][inside[1] > j]
                    if len(at):
                        yield emit(doc[at + i], doc[at + j], key[at], np.zeros(len(at)))
            wide = np.flatnonzero(inner & (size > SMALL))
            for w in wide.tolist():
                lo, hi = cut[w], cut[w] + size[w]
                yield emit(np.full(hi - lo - 1, doc[lo]), doc[lo + 1 : hi], key[lo + 1 : hi], np.full(hi - lo - 1, hi - lo))
            for w in sorted({0, len(cut) - 1}):
                lo, hi = int(cut[w]), int(cut[w] + size[w])
                if key[lo] != open_key:
                    yield from close()
                    held, open_key, count = [], key[lo], 0
                before = count
                count += hi - lo
                if count <= SMALL:
                    held += [(d,) for d in doc[lo:hi].tolist()]
                    continue
                late = np.array([x[0] for x in held[: before if before <= SMALL else 1]], np.int64)
                if before <= SMALL:  # it grows beyond SMALL just now
                    members = np.concatenate([late, doc[lo:hi]])
                    held = [(int(members[0]),)]
                    members = members[1:]
                else:
                    members = doc[lo:hi]
                yield emit(np.full(len(members), held[0][0]), members, np.full(len(members), open_key, np.int64), np.full(len(members), count))
        yield from close()

    n = C.shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, "key").sortWithinPartitions("key", "_d").mapInArrow(C.tidy(run), "a long, b long, key long, members int")


def verify(docs: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, na, nb, shared) of distinct pairs (a, b, members), on the whole shingle sets.

    Pairs of a document are verified in units of about UNIT, each of which gets the documents' texts.
    """
    units = F.greatest(F.lit(1), F.ceil(F.col("members") / UNIT)).cast("long")
    unit = F.xxhash64("a", units, F.pmod(F.xxhash64("b"), units))
    edges = pairs.groupBy("a", "b").agg(F.max("members").alias("members")).select("a", "b", unit.alias("unit"))
    partners = edges.select("unit", "a", F.col("b").alias("_d"), F.lit(True).alias("partner"))
    members = partners.unionByName(edges.select("unit", "a", F.col("a").alias("_d"), F.lit(False).alias("partner")).distinct())
    n = C.shuffle_partitions(docs.sparkSession)
    rows = members.join(docs.select("_d", "text").hint("merge"), "_d").repartition(n, "unit").sortWithinPartitions("unit", "a", "partner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        for batch in batches:
            for part, buf, offs in C.text_chunks(batch):
                row, hashes, second = checked_shingles(buf, offs, rule.words)
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                out: list[tuple] = []
                for i, (a, d, partner) in enumerate(zip(*(part.column(c).to_pylist() for c in ("a", "_d", "partner")), strict=True)):
                    own = hashes[cut[i] : cut[i + 1]], second[cut[i] : cut[i + 1]]
                    if not partner:
                        mine = own[0].copy(), own[1].copy()
                        continue
                    out.append((a, d, len(mine[0]), len(own[0]), shared_shingles(mine, own)))
                values = np.array(out, np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([pa.array(values[:, i]) for i in range(5)], ["a", "b", "na", "nb", "shared"])

    return rows.select("a", "_d", "partner", "text").mapInArrow(C.tidy(run), "a long, b long, na long, nb long, shared long")


def second_pairs(edges: DataFrame, labels: DataFrame, profile: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of different components, within segments whose documents did not all join one component, whose sketches allow a link.

    A segment's documents are dealt into chunks of about CHUNK; all of them stream past each chunk, so a segment spreads over
    tasks, and only the pairs that pass are sent on.
    """
    tags = labels.select(F.col("node").alias("_d"), "component")
    wide = edges.where("members > 0")
    x = wide.select("key", F.col("b").alias("_d")).unionByName(wide.select("key", F.col("a").alias("_d")).distinct())
    x = x.join(tags, "_d", "left").withColumn("component", F.coalesce("component", "_d"))
    open_keys = x.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.ceil(F.count("*") / CHUNK).alias("_chunks")).where("_lo <> _hi").select("key", "_chunks")
    parts = open_keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a segment may hold a third of all documents
    x = x.withColumn("_salt", F.pmod(F.xxhash64("_d"), F.lit(SALTS)).cast("int")).join(parts, ["key", "_salt"]).join(profile, "_d")
    x = x.withColumn("_copy", F.explode(F.sequence(F.lit(-1).cast("long"), F.col("_chunks") - 1)))  # -1: indexed in its own chunk
    own = F.pmod(F.xxhash64("_d"), F.col("_chunks"))
    x = x.select("key", F.when(F.col("_copy") < 0, own).otherwise(F.col("_copy")).alias("chunk"), (F.col("_copy") >= 0).alias("probe"), "_d", "component", "n", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("key", "chunk", "probe", "_d", "component", "n", "sketch")), strict=True))
            out: list[tuple] = []
            for key, chunk, probe, d, component, n, sketch in rows:
                if (key, chunk) != group:
                    group, held, index = (key, chunk), [], None
                if not probe:
                    held.append((d, component, n, sketch))
                    continue
                if index is None:
                    if not held:
                        continue
                    size = min(len(h[3]) for h in held)
                    index = [np.array([h[i] for h in held], np.int64) for i in range(3)]
                    bits = np.frombuffer(b"".join(folded(h[3], size) for h in held), np.uint64).reshape(len(held), -1)
                    by_size = {size: bits}
                at = min(size, len(sketch))
                if at not in by_size:
                    by_size[at] = np.frombuffer(b"".join(folded(h[3], at) for h in held), np.uint64).reshape(len(held), -1)
                mine = np.frombuffer(folded(sketch, at), np.uint64)
                far = np.bitwise_count(by_size[at] ^ mine).sum(axis=1, dtype=np.int64)
                hit = may_link(rule, index[2], n, far) & (index[1] != component) & (index[0] < d)
                out += [(a, d) for a in index[0][hit].tolist()]
            if out:
                a, b = np.array(out, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a.copy()), pa.array(b.copy())], ["a", "b"])

    n = C.shuffle_partitions(edges.sparkSession)
    pairs = x.repartition(n, "key", "chunk").sortWithinPartitions("key", "chunk", "probe").mapInArrow(C.tidy(run), "a long, b long")
    return pairs.distinct().withColumn("members", F.lit(UNIT))


def classes(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame | None]:
    """(found, names): found has _d, n_shingles and component_id, the least _d reachable over links; names as of numbered()."""
    rows, names = numbered(docs)
    copies = rows.select("_d", F.xxhash64("text").alias("h"), F.md5(F.encode("text", "UTF-8")).alias("m")).where("text is not null")
    first = copies.groupBy("h", "m").agg(F.min("_d").alias("first"), F.count("*").alias("copies"))
    others = C.stash(copies.join(first.where("copies > 1"), ["h", "m"]).where("_d <> first").select("first", "_d"), "copies")
    own = rows.join(others.select("_d").hint("merge"), "_d", "left_anti").where("text is not null")
    profile = C.stash(profiles(rows, rule), "profiles")
    edges = C.stash(bucket_pairs(sketch_rows(own, rule, frequent_segments(own, rule))), "pairs")
    hit = F.expr(f"{rule.den} * shared >= {rule.num} * (na + nb - shared) and shared > 0")
    first_pairs = C.stash(sketch_filter(edges, profile, rule), "first")
    labels = components(C.stash(verify(rows, first_pairs, rule), "checked").where(hit).select("a", "b"))
    more = C.stash(second_pairs(edges, labels, profile, rule).join(first_pairs, ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        late = C.stash(verify(rows, more, rule).where(hit).select("a", "b"), "late")
        if not late.isEmpty():
            merged = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
            labels = components(merged.unionByName(late))
    out = profile.select("_d", F.col("n").alias("n_shingles")).join(others.select("_d", "first"), "_d", "left").withColumn("node", F.coalesce("first", "_d"))
    out = out.join(labels, "node", "left").select("_d", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).otherwise(F.col("_d")).alias("component_id"))
    return out, names


def near_duplicates(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: component_id is the least doc_id reachable over links, itself included.

    Null texts and texts without words have no shingles and no links. Rows equal in doc_id and text count as one document.
    Other columns are not used; an empty input gives an empty result.
    """
    return named(*classes(docs, rule), ("component_id",))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"), Rule(4, 85))
