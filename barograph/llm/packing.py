"""Best-fit-decreasing packing of tokenised documents into sequences of bounded length.

Lengths are integers up to the capacity, so best-fit decreasing depends on the histogram of lengths alone. The histogram
(at most `capacity` rows, whatever the input) is packed on the driver, with a segment tree over remaining capacities that
finds the tightest open bin in logarithmic time; bins of equal remaining capacity move together, as ranges of bin numbers.
Executors then rank every piece among those of its length and look its place up in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.llm import common as C

CAPACITY = 2048
TOKENIZER_FILE = "word_bpe_49k.json"
END_ID = 0
#: Entries of a worker's table from word to ids, and their bytes; beyond either the table starts anew. Bounds memory, never results.
WORD_CACHE, WORD_BYTES = 300_000, 16 << 20


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_ASCII_OTHER = ~_ASCII_LETTER
_ASCII_OTHER[128:] = False
_APOSTROPHE = 0x27
_PLAIN = _ASCII_LETTER.copy()
_PLAIN[0x80:0xC0] = _PLAIN[0xC3:0xC6] = True


def is_plain(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which spans hold nothing but letters of ASCII and of U+00C0 to U+017F that lower-case to one letter: these are in
    normal form, and each is one word of the model."""
    odd = ~_PLAIN[buf]
    pair = (buf[:-1].astype(np.int32) << 8) | buf[1:]
    odd[:-1] |= (pair == 0xC397) | (pair == 0xC3B7) | (pair == 0xC4B0)
    count = np.concatenate([[0], np.cumsum(odd)])
    return count[end] == count[start]


def token_units(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs between white space, cut once more between ASCII letters and other ASCII signs (not after an apostrophe).

    No token of a tokenizer that matches letters, numbers, other signs and apostrophe endings apart crosses these cuts.
    """
    start, end, row = C.words(buf, offs)
    if not len(start):
        return start, end, row
    letter, other = _ASCII_LETTER[buf], _ASCII_OTHER[buf] & ~C.WHITE[buf]
    cut = np.zeros(len(buf), bool)
    cut[1:] = (letter[:-1] & other[1:]) | (other[:-1] & letter[1:] & (buf[:-1] != _APOSTROPHE))
    cut[start] = False
    at = np.flatnonzero(cut)
    at = at[at < end[np.searchsorted(start, at, "right") - 1]]
    begins = np.sort(np.concatenate([start, at]), kind="stable")
    ends = np.sort(np.concatenate([end, at]), kind="stable")
    return begins, ends, row[np.searchsorted(start, begins, "right") - 1]


def distinct_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first span of each distinct content, number of each span's content). Spans meet by digest; their bytes
    decide."""
    view = C.lanes(buf)
    _, first, back = np.unique(C.span_digests(view, buf, start, end), return_index=True, return_inverse=True)
    to = first[back]
    if not C.same_spans(view, buf, start, end, start[to], end[to]).all():  # a digest that two contents share
        numbers: dict[bytes, int] = {}
        back = np.array([numbers.setdefault(buf[a:b].tobytes(), len(numbers)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
        _, first = np.unique(back, return_index=True)
    return first, back


class WordTokenizer:
    """ids of whole texts, by tokenising each distinct unit (see token_units) once.

    Valid for lower-casing tokenizers that drop white space, such as word_bpe_49k.json.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # The same model for words that are lower-case Latin letters already: each is one word of the model.
        self.letters = Tokenizer.from_file(path)
        self.letters.encode_special_tokens = True
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.letters.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.start = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, np.int32)
        self.used = 0

    def keep(self, keys: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        have = len(self.known)
        while have + len(keys) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.start[have : have + len(keys)] = self.used + np.cumsum(counts) - counts
        self.count[have : have + len(keys)] = counts
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known.update(zip(keys, range(have, have + len(keys)), strict=True))
        self.held += sum(map(len, keys))

    def learn(self, keys: list[bytes], buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[int]:
        """Slots of new units, given by their bytes and their places in buf."""
        plain = is_plain(buf, start, end)
        if plain.any():
            begin, size = start[plain], (end - start)[plain] + 1  # with the blank behind each
            at = np.cumsum(size)
            joined = buf[np.minimum(np.repeat(begin - at + size, size) + np.arange(at[-1]), len(buf) - 1)]
            joined[at - 1] = 0x20
            text = joined.tobytes().decode().lower()
            ids = np.asarray(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            self.keep([keys[i] for i in np.flatnonzero(plain).tolist()], ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1))
        if not plain.all():
            rest = [keys[i] for i in np.flatnonzero(~plain).tolist()]
            got = self.tokenizer.encode([k.decode("utf-8", "replace") for k in rest], is_pretokenized=True, add_special_tokens=False)
            of = np.asarray(got.word_ids, np.int64)
            self.keep(rest, np.asarray(got.ids, np.int32), np.bincount(of, minlength=len(rest)) if len(of) else np.zeros(len(rest), np.int64))
        return [self.known[k] for k in keys]

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, one after the other, and the number of ids of each row."""
        start, end, row = token_units(buf, offs)
        n = len(offs) - 1
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        first, back = distinct_spans(buf, start, end)
        raw = buf.tobytes()
        keys = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        if self.known and (len(self.known) + len(keys) > WORD_CACHE or self.held > WORD_BYTES):
            self.clear()
        slots = np.fromiter((self.known.get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = self.learn([keys[i] for i in new.tolist()], buf, start[first[new]], end[first[new]])
        slot = slots[back]
        counts = self.count[slot]
        ends = np.cumsum(counts)
        ids = self.pool[np.repeat(self.start[slot] - ends + counts, counts) + np.arange(ends[-1])]
        return ids, np.bincount(row, weights=counts, minlength=n).astype(np.int64)


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> WordTokenizer:
    """One a worker process, whatever number of tasks it runs."""
    return WordTokenizer(path)


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids of every document: its ids, then `end_id`.

    Null or empty text: one piece that holds only `end_id`. Repeated rows give their pieces each; a null doc_id stays null.
    Only documents longer than `capacity` are cut. `with_ids` adds the ids themselves. Other columns of docs are not used.
    """
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer_of(tokenizer_path)
        for batch in batches:
            for rows, buf, offs in C.text_chunks(batch):
                ids, counts = tok.encode(buf, offs)
                total = counts + 1
                at = np.cumsum(total) - total
                flat = np.full(int(total.sum()), end_id, np.int32)
                keep = np.ones(len(flat), bool)
                keep[at + counts] = False
                flat[keep] = ids
                pieces = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, total[row] - start)
                raw = memoryview(flat.astype("<u4")).cast("B")
                lo = ((at[row] + start) * 4).tolist()
                hi = ((at[row] + start + length) * 4).tolist()
                crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(lo, hi, strict=True)), np.int64, len(row))
                out = [rows.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(C.array_of(flat, length))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(C.tidy(run), schema)


class CapacityTree:
    """Segment tree over capacities 0..top with the number of open bins below each node."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.n = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        i = capacity + self.leaves
        while i:
            self.n[i] += bins
            i >>= 1

    def tightest(self, need: int) -> int:
        """The smallest capacity of at least `need` with an open bin, or -1."""
        i = need + self.leaves
        if self.n[i]:
            return need
        while i > 1:
            if not i & 1 and self.n[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.n[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


@dataclass
class Plan:
    """Places by length and rank: ranks from `rank` on fill bins from `bin` on, `each` a bin, from `offset` on."""

    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    bins: int = 0


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The best-fit-decreasing packing of a histogram {length: pieces}, in steps that move whole ranges of equal bins."""
    plan, tree = Plan(), CapacityTree(capacity)
    open_bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # ranges (first bin, bins) by capacity left

    def put(left: int, first: int, bins: int) -> None:
        if bins:
            open_bins[left].append((first, bins))
            tree.add(left, bins)

    for length in sorted(histogram, reverse=True):
        rank, rest = 0, histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length} does not fit {capacity}")

        def fill(left: int, first: int, bins: int, each: int, length: int = length) -> None:
            nonlocal rank, rest
            for name, value in (("length", length), ("rank", rank), ("bin", first), ("each", each), ("offset", capacity - left)):
                getattr(plan, name).append(value)
            rank += bins * each
            rest -= bins * each
            put(left - each * length, first, bins)

        while rest:
            left = tree.tightest(length)
            if left < 0:
                each = capacity // length
                new = max(1, rest // each) if rest >= each else 1
                first, bins, left = plan.bins, new, capacity
                plan.bins += new
            else:
                each = left // length
                first, bins = open_bins[left].pop()
                tree.add(left, -bins)
            full = min(bins, rest // each)
            if full:
                fill(left, first, full, each)
            if rest and full < bins:
                fill(left, first + full, 1, rest)
                full += 1
            put(left, first + full, bins - full)
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset (longs) to pieces with a `length` from 1 to `capacity`: sequences are gapless from 0.

    `pieces` is read twice, so hand in a written table. Ties in `order` (repeated rows) take any order among themselves.
    An empty input gives an empty result. Ranks come from groups of about the square root of each length's pieces, dealt by
    a hash of `order`, so that a length that a third of the pieces share is still spread out.
    """
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit_decreasing(counts, capacity)
    spark = pieces.sparkSession
    sizes = spark.createDataFrame([(k, max(1, round(n**0.5))) for k, n in counts.items()], "length long, _groups long")  # at most `capacity` rows
    dealt = pieces.join(F.broadcast(sizes), "length").withColumn("_group", F.pmod(F.xxhash64(*order), F.col("_groups"))).drop("_groups")
    totals = dealt.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    before = totals.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_group").orderBy(*order)) - 1)
    ranked = ranked.join(before.select("length", "_group", F.coalesce("_before", F.lit(0)).alias("_before")), ["length", "_group"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    return place(ranked.select(*pieces.columns, "_rank"), plan)


def place(ranked: DataFrame, plan: Plan) -> DataFrame:
    """Looks sequence_id and offset up by (length, _rank); the plan grows with the capacity, not with the input."""
    by = sorted(range(len(plan.length)), key=lambda i: (plan.length[i], plan.rank[i]))
    lengths, ranks, bins, each, offsets = (np.array([getattr(plan, n)[i] for i in by], np.int64) for n in ("length", "rank", "bin", "each", "offset"))
    columns = [c for c in ranked.columns if c != "_rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank") + ", sequence_id long, offset long"
    firsts = {int(k): i for i, k in reversed(list(enumerate(lengths.tolist())))}
    lasts = {int(k): i + 1 for i, k in enumerate(lengths.tolist())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            entry = np.zeros(len(length), np.int64)
            for k in np.unique(length).tolist():
                lo, hi = firsts[k], lasts[k]
                mine = length == k
                entry[mine] = lo + np.searchsorted(ranks[lo:hi], rank[mine], "right") - 1
            nth = rank - ranks[entry] if len(entry) else rank
            sequence = bins[entry] + nth // each[entry] if len(entry) else rank
            offset = offsets[entry] + nth % each[entry] * length if len(entry) else rank
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(C.tidy(run), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, (sequence_id, ids), from pieces made with ids; each is bounded by the capacity."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack all documents. See tokenize_pieces() and pack() for nulls, ties and empty input."""
    return pack(C.stash(tokenize_pieces(docs, tokenizer_path, capacity), "pieces"), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(C.table(spark, sf_dir, "documents"), default_tokenizer())
