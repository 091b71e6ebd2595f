"""Removal of repeated byte strings, by hash-compared suffix sorting.

Every window of LENGTH bytes contains K-byte grams, the least of which (by hash) is its anchor. Equal windows have equal
anchors at equal places, so only windows with the same anchor hash are ever compared. Consecutive windows that share an anchor
occurrence form a cell. Then:

1. each block of documents sends one row per distinct cell (what repeats inside a block is settled there), so a string that a
   third of all documents share sends one row per block;
2. rows meet by anchor hash (anchors that a scan of some documents finds frequent also by cell, which only routes rows): all
   but the first of equal cells are repeats. Cells are equal when their anchors' hashes, their polynomial hashes and independent
   non-linear digests of their bytes all agree. Of the distinct cells of an anchor, two can share a window only if they share
   the anchor with half the rest of a window on its left or on its right; those that share neither (by hash) are done, and the
   others ask for the bytes of the first of each. Chance anchors, which grow faster than the text, end here;
3. those cells meet by anchor, and their windows are suffix-sorted: prefix polynomial hashes and binary search give common
   extensions, so a comparison in the mergesort takes logarithmic time; windows found equal are verified byte by byte.
   Anchors with more than GROUP such cells come window by window instead, so that no group grows with the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm import common as C
from barograph.llm.identity import named, numbered

LENGTH = 100
K = 16
#: Text whose cells a map task compares at once.
BLOCK_BYTES = 16 << 20
#: Distinct cells of an anchor that are compared in one group.
GROUP = 16384
#: Distinct cells of an anchor of which a task holds places and sides; beyond, all are compared window by window.
HELD = 1 << 20
#: One document in SCAN is looked at for frequent anchors: those in more than FREQUENT of them.
SCAN, FREQUENT = 64, 0.01
_U = np.uint64


def cells(buf: np.ndarray, offs: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(row, start, windows, place of the anchor in the cell, anchor hash, cell hash, cell digest, sides) of the cells of all rows."""
    n = len(buf)
    none = np.zeros(0, np.int64)
    rows = np.flatnonzero(np.diff(offs) >= length)
    if not len(rows):
        return none, none, none, none, *(none.astype(np.uint64) for _ in range(4))
    prefix = C.prefix_hashes(buf)
    _, down = C.powers(n + 1)
    grams = (prefix[k:] - prefix[:-k]) * down[: n + 1 - k]
    grams *= _U(0x9FB21C651E98DF25)
    grams ^= grams >> _U(32)
    low = (grams << _U(32)) | np.arange(len(grams), dtype=np.uint64)
    span, width = length - k + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    anchor = (low & _U(0xFFFFFFFF)).astype(np.int64)
    change = np.empty(len(anchor), bool)
    change[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=change[1:])
    begin, end = offs[:-1][rows], offs[1:][rows] - length + 1
    change[begin] = True
    valid = np.zeros(n + 1, np.int8)
    np.add.at(valid, begin, 1)
    np.add.at(valid, end, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)[: len(anchor)]
    start = np.flatnonzero(change & valid)
    row = np.searchsorted(offs, start, "right") - 1
    stop = np.append(start[1:], n)
    windows = np.minimum(stop, offs[row + 1] - length + 1) - start
    at = anchor[start]
    end = start + windows + length - 1
    whole = C.mix(C.span_hashes(prefix, start, end)) + windows.astype(np.uint64)
    digest = C.span_digests(C.lanes(buf), buf, start, end)
    return row, start - offs[row], windows, at - start, C.mix(grams[at]), whole, digest, sides(prefix, start, end, at, length, k)


def sides(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, length: int, k: int) -> np.ndarray:
    """Hashes of 32 bits of each anchor with the bytes on its left (above) and on its right (below); 0: the cell ends before.

    A window has length - k bytes beside its anchor, so at least half of them, rounded up, lie on one side of it: cells that
    share a window agree in that side.
    """
    half = (length - k + 1) // 2

    def hashed(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out, there = np.zeros(len(at), np.uint64), np.flatnonzero((lo >= start) & (hi <= end))
        out[there] = np.maximum(C.mix(C.span_hashes(prefix, lo[there], hi[there])) >> _U(32), _U(1))
        return out

    return hashed(at - half, at + k) << _U(32) | hashed(at, at + k + half)


def shares_side(group: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Whether another cell of the same group (numbers below 2**31) has the same left or right side."""
    out = np.zeros(len(sides), bool)
    for side in (sides.view(np.uint64) >> _U(32), sides.view(np.uint64) & _U(0xFFFFFFFF)):
        key = group.astype(np.uint64) << _U(32) | side
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.append(same, False) | np.append(False, same)
        out[order] |= twice & (side[order] != 0)
    return out


#: `span` packs start, windows, place, whether the anchor is frequent and whether the cell repeats one of its block.
CELL_SCHEMA = "anchor long, cell long, digest long, _d long, span long, sides long"
SPAN_BITS = 12


def pack_span(start, windows, place, hot, repeat) -> np.ndarray:
    return (((start.astype(np.int64) << SPAN_BITS | windows) << SPAN_BITS | place) << 2) | (hot.astype(np.int64) << 1) | repeat


def unpack_span(span: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, windows, place, repeat) of packed spans."""
    least = (1 << SPAN_BITS) - 1
    return (span >> (2 * SPAN_BITS + 2)).astype(np.int32), (span >> (SPAN_BITS + 2) & least).astype(np.int16), (span >> 2 & least).astype(np.int16), (span & 1).astype(bool)


def block_cells(docs: DataFrame, frequent: np.ndarray, length: int, k: int) -> DataFrame:
    """The cells of all documents, repeats inside a block marked. Frequent anchors are routed with their cell."""

    if length - k + 1 >= 1 << SPAN_BITS:
        raise ValueError(f"windows of {length} bytes are too long for their packed places")

    def settle(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        doc, start, windows, place, anchor, cell, digest, side = (np.concatenate(x) for x in zip(*held, strict=True))
        key = C.mix(anchor ^ (cell * _U(0x9E3779B97F4A7C15))) + digest
        order = np.lexsort((start, doc, key))
        doc, start, windows, place, anchor, cell, digest, side, key = (x[order] for x in (doc, start, windows, place, anchor, cell, digest, side, key))
        repeat = np.zeros(len(key), bool)
        repeat[1:] = (key[1:] == key[:-1]) & (anchor[1:] == anchor[:-1]) & (cell[1:] == cell[:-1]) & (digest[1:] == digest[:-1])
        at = np.minimum(np.searchsorted(frequent, anchor), max(len(frequent) - 1, 0))
        hot = frequent[at] == anchor if len(frequent) else np.zeros(len(anchor), bool)
        span = pack_span(start, windows, place, hot, repeat)
        side[repeat] = 0  # not asked for again
        for lo in range(0, len(key), 50_000):
            s = slice(lo, lo + 50_000)
            hashes = (pa.array(x[s].view(np.int64)) for x in (anchor, cell, digest))
            yield pa.RecordBatch.from_arrays([*hashes, pa.array(doc[s]), pa.array(span[s]), pa.array(side[s].view(np.int64))], ["anchor", "cell", "digest", "_d", "span", "sides"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for rows, buf, offs in C.text_chunks(batch):
                row, *rest = cells(buf, offs, length, k)
                held.append((rows.column("_d").to_numpy()[row], *rest))
                size += len(buf)
                if size >= BLOCK_BYTES:
                    yield from settle(held)
                    held, size = [], 0
        if held:
            yield from settle(held)

    return docs.mapInArrow(C.tidy(run), CELL_SCHEMA)


def frequent_anchors(docs: DataFrame, length: int, k: int) -> np.ndarray:
    """Anchors in more than FREQUENT of some documents: at most as many as a document has anchors, over FREQUENT.

    They only route rows. Which documents are looked at, and so this list, changes no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, offs in C.text_chunks(batch):
                row, _, _, _, anchor, *_ = cells(buf, offs, length, k)
                pairs = np.unique(np.stack([row.astype(np.uint64), anchor], 1), axis=0) if len(row) else np.zeros((0, 2), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1].copy().view(np.int64))], ["anchor"])

    some = docs.where(F.pmod(F.xxhash64("_d"), F.lit(SCAN)) == 0)
    n = some.count()
    found = some.mapInArrow(C.tidy(run), "anchor long").groupBy("anchor").count().where(F.col("count") > max(8, FREQUENT * n))
    return np.sort(np.array([r["anchor"] for r in found.select("anchor").collect()], np.int64).view(np.uint64))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 8_000) -> Iterator[pa.Table]:
    """Tables of about `rows` rows from batches sorted by `key` that never split a group. The caller bounds the groups."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= rows:
            keys = batch.column(key).to_numpy()
            last = held[-1].column(key)[-1].as_py()
            cut = int(np.argmax(keys != last)) if (keys != last).any() else len(keys)
            if cut:
                held.append(batch.slice(0, cut))
                batch = batch.slice(cut)
            if batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


FOUND_SCHEMA = "_d long, start int, windows short, place short, anchor long, kind byte"
REPEAT, ASKED, ASKED_BY_WINDOW = 0, 1, 2


def settle_cells(rows: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Repeats among cells, and the first of each distinct cell that may share a window with another of its anchor.

    Rows stream in the order (anchor, cell, digest, document, start). Of an open group only the firsts are held, up to HELD of them;
    beyond, they are asked for window by window and the group goes on as such. The cells of frequent anchors lie in several
    tasks, so all of them are asked for, by window.
    """

    def emit(d, start, windows, place, anchor, kind) -> pa.RecordBatch:
        kinds = np.full(len(d), kind, np.int8) if np.isscalar(kind) else kind.astype(np.int8)
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(start), pa.array(windows), pa.array(place), pa.array(anchor), pa.array(kinds)], ["_d", "start", "windows", "place", "anchor", "kind"])

    def ask(group, is_hot, d, start, windows, place, anchor, side) -> Iterator[pa.RecordBatch]:
        """Whole groups: what has to be asked for."""
        take = is_hot | shares_side(group, side)
        if take.any():
            wide = np.bincount(group, take)[group] > GROUP
            yield emit(*(x[take] for x in (d, start, windows, place, anchor)), np.where(is_hot | wide, ASKED_BY_WINDOW, ASKED)[take])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.view(np.int64)
        hot = np.sort(hot)

        def ask_open(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            values = [np.concatenate(x) for x in zip(*held, strict=True)]
            return ask(np.zeros(len(values[0]), np.int64), _in(values[4], hot), *values)

        last = None  # (anchor, cell, digest) of the open cell
        held: list[tuple[np.ndarray, ...]] = []  # firsts of the open group
        wide = False  # the open group is asked for window by window
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, cell, digest, d, span, side = (batch.column(c).to_numpy() for c in ("anchor", "cell", "digest", "_d", "span", "sides"))
            start, windows, place, repeat = unpack_span(span)
            if repeat.any():
                yield emit(d[repeat], start[repeat], windows[repeat], place[repeat], anchor[repeat], REPEAT)
                anchor, cell, digest, d, start, windows, place, side = (x[~repeat] for x in (anchor, cell, digest, d, start, windows, place, side))
                if not len(d):
                    continue
            new_anchor, new_cell = np.ones(len(d), bool), np.ones(len(d), bool)
            new_anchor[1:] = anchor[1:] != anchor[:-1]
            new_cell[1:] = new_anchor[1:] | (cell[1:] != cell[:-1]) | (digest[1:] != digest[:-1])
            if last is not None:
                new_anchor[0] = anchor[0] != last[0]
                new_cell[0] = (anchor[0], cell[0], digest[0]) != last
            again = ~new_cell
            if again.any():
                yield emit(d[again], start[again], windows[again], place[again], anchor[again], REPEAT)
            first = np.flatnonzero(new_cell)
            if not len(first):
                continue
            last = (anchor[first[-1]], cell[first[-1]], digest[first[-1]])
            values = [x[first] for x in (d, start, windows, place, anchor, side)]
            begins = new_anchor[first]
            if not begins[0]:  # the open group goes on
                head = int(np.argmax(begins)) if begins.any() else len(begins)
                part = tuple(x[:head] for x in values)
                if wide:
                    yield emit(*part[:5], ASKED_BY_WINDOW)
                else:
                    held.append(part)
                    if sum(len(x[0]) for x in held) > HELD:
                        yield emit(*[np.concatenate(x) for x in zip(*held, strict=True)][:5], ASKED_BY_WINDOW)
                        held, wide = [], True
                values, begins = [x[head:] for x in values], begins[head:]
                if not len(begins):
                    continue
            if held:
                yield from ask_open(held)
            held, wide = [], False
            cut = np.flatnonzero(begins)[-1]  # the last group stays open
            held.append(tuple(x[cut:] for x in values))
            if cut:
                values = [x[:cut] for x in values]
                yield from ask(np.cumsum(begins[:cut]) - 1, _in(values[4], hot), *values)
        if held:
            yield from ask_open(held)

    n = C.shuffle_partitions(rows.sparkSession)
    span = F.col("span")
    passes = span.bitwiseAND(F.lit(1)) == 1  # repeats only pass through
    route = F.when(passes, F.xxhash64("_d", "span")).when(span.bitwiseAND(F.lit(2)) == 2, F.xxhash64("anchor", "cell", "digest")).otherwise(F.col("anchor"))
    return rows.repartition(n, route).sortWithinPartitions("anchor", "cell", "digest", "_d", "span").mapInArrow(C.tidy(run), FOUND_SCHEMA)


def _in(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


TEXT_SCHEMA = "anchor long, _d long, start int, place short, bytes binary"


def asked_bytes(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """The bytes of the cells asked for. Those asked for by window come as cells of one window each, under the window's hash;
    bytes null: `place` windows from start on have stood earlier in this task, so they are repeats."""
    wanted = asked.groupBy("_d").agg(F.collect_list(F.struct("start", "windows", "place", "anchor", "kind")).alias("wanted"))  # bounded by the document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            out: list[tuple] = []
            size = 0
            lists = batch.column("wanted")
            ends = np.asarray(lists.offsets)
            flat = lists.flatten()
            base = ends[0]
            fields = [flat.field(i).to_numpy(zero_copy_only=False).tolist() for i in range(5)]
            texts = batch.column("text").cast(pa.binary())
            for i, d in enumerate(batch.column("_d").to_pylist()):
                raw = texts[i].as_py() or b""
                for j in range(ends[i] - base, ends[i + 1] - base):
                    start, windows, place, anchor, kind = (f[j] for f in fields)
                    if kind == ASKED:
                        out.append((anchor, d, start, place, raw[start : start + windows + length - 1]))
                        size += 200
                        continue
                    run = 0  # windows just before that have stood earlier in this task
                    for s in range(start, start + windows):
                        window = raw[s : s + length]
                        best = seen.get(window)
                        if best is not None and best < (d, s):
                            run += 1
                            continue
                        if run:
                            out.append((0, d, s - run, run, None))
                            run = 0
                        if len(seen) >= 100_000:
                            seen.clear()
                        seen[window] = (d, s)
                        key = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)
                        out.append((key, d, s, 0, window))
                        size += 130
                    if run:
                        out.append((0, d, start + windows - run, run, None))
                if size > 4_000_000 or len(out) > 50_000:
                    yield _text_batch(out)
                    out, size = [], 0
            if out:
                yield _text_batch(out)

    return docs.join(wanted.hint("merge"), "_d").select("_d", "text", "wanted").mapInArrow(C.tidy(run), TEXT_SCHEMA)


def _text_batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.binary()), strict=True)], ["anchor", "_d", "start", "place", "bytes"])


# --- suffix sort ----------------------------------------------------------------------------------------------------


class Suffixes:
    """Suffixes of one byte string, compared over `length` bytes through prefix polynomial hashes."""

    def __init__(self, buf: np.ndarray, length: int):
        self.buf, self.length, self.prefix = buf, length, C.prefix_hashes(buf)
        _, self.down = C.powers(len(buf) + 1)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bytes that suffixes x and y have in common, up to `length`, by binary search over hashes."""
        same = np.zeros(len(x), np.int64)
        step = 1 << (self.length.bit_length() - 1)
        px, py, dx, dy = self.prefix[x], self.prefix[y], self.down[x], self.down[y]
        top = len(self.prefix) - 1
        while step:
            to = same + step
            fits = to <= self.length
            ex, ey = np.minimum(x + to, top), np.minimum(y + to, top)
            equal = (self.prefix[ex] - px) * dx == (self.prefix[ey] - py) * dy
            same = np.where(fits & equal, to, same)
            step >>= 1
        return same

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        same = self.extension(x, y)
        whole = same >= self.length
        i = np.where(whole, 0, same)
        return np.where(whole, or_equal, self.buf[x + i] < self.buf[y + i])


def sort_suffixes(suffixes: Suffixes, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """A stable order of the suffixes `at` inside each run of equal `segment`: bottom-up mergesort, all merges of a level at
    once; an element's place in a merge is found by binary search in the other run."""
    n = len(at)
    order = np.arange(n)
    cut = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(cut, n))
    first, count = np.repeat(cut, size), np.repeat(size, size)
    width = 1
    while n and width < size.max():
        p = np.flatnonzero(count > width)
        inside = p - first[p]
        run = inside // width
        right = run % 2 == 1
        pair = first[p] + run // 2 * 2 * width
        end = first[p] + count[p]
        middle = np.minimum(pair + width, end)
        lo = np.where(right, pair, middle)
        hi = np.where(right, middle, np.minimum(pair + 2 * width, end))
        begin = lo.copy()
        own = at[order[p]]
        while len(live := np.flatnonzero(lo < hi)):
            mid = (lo[live] + hi[live]) // 2
            other = at[order[mid]]
            goes_first = suffixes.less(other, own[live], right[live])  # the other stands before; on ties, if it is on the left
            lo[live] = np.where(goes_first, mid + 1, lo[live])
            hi[live] = np.where(goes_first, hi[live], mid)
        to = np.where(right, p - middle, p - pair) + (lo - begin) + pair
        moved = order.copy()
        moved[to] = order[p]
        order = moved
        width *= 2
    return order


def equal_before(buf: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """Whether the windows at x and y are equal byte by byte."""
    out = np.empty(len(x), bool)
    reach = np.arange(length)
    for lo in range(0, len(x), 10_000):
        s = slice(lo, lo + 10_000)
        out[s] = (buf[x[s, None] + reach] == buf[y[s, None] + reach]).all(axis=1)
    return out


def repeats_in(buf: np.ndarray, group: np.ndarray, base: np.ndarray, windows: np.ndarray, place: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, window in it) of the windows that stand in an earlier cell of their group too."""
    cell = np.repeat(np.arange(len(group)), windows)
    j = np.arange(len(cell)) - np.repeat(np.cumsum(windows) - windows, windows)
    shift = place[cell] - j  # equal windows have their anchor at the same place
    order = np.lexsort((start[cell], doc[cell], shift, group[cell]))
    cell, j, shift = cell[order], j[order], shift[order]
    change = np.ones(len(cell), bool)
    change[1:] = (group[cell[1:]] != group[cell[:-1]]) | (shift[1:] != shift[:-1])
    segment = np.cumsum(change) - 1
    many = np.bincount(segment)[segment] > 1 if len(segment) else change
    cell, j, segment = cell[many], j[many], segment[many]
    if not len(cell):
        return cell, j
    at = base[cell] + j
    suffixes = Suffixes(buf, length)
    order = sort_suffixes(suffixes, at, segment)
    cell, j, at, segment = cell[order], j[order], at[order], segment[order]
    follows = np.zeros(len(cell), bool)
    near = segment[1:] == segment[:-1]
    follows[1:] = near & (suffixes.extension(at[1:], at[:-1]) >= length)
    claimed = np.flatnonzero(follows)
    if not equal_before(buf, at[claimed], at[claimed - 1], length).all():  # a hash collision: sort these by their bytes
        keys = np.array([buf[a : a + length].tobytes() for a in at.tolist()], dtype=object)
        order = sorted(range(len(at)), key=lambda i: (segment[i], keys[i], doc[cell[i]], start[cell[i]]))
        cell, j, segment, keys = cell[order], j[order], segment[order], keys[order]
        follows = np.append(False, (segment[1:] == segment[:-1]) & (keys[1:] == keys[:-1]))
    return cell[follows], j[follows]


def settle_windows(texts: DataFrame, length: int) -> DataFrame:
    """(_d, start, windows) of the repeats among asked-for cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "anchor"):
            doc, start, place = (t.column(c).to_numpy() for c in ("_d", "start", "place"))
            null = t.column("bytes").is_null().to_numpy()
            if null.any():
                yield pa.RecordBatch.from_arrays([pa.array(doc[null]), pa.array(start[null]), pa.array(place[null])], ["_d", "start", "windows"])
            keep = np.flatnonzero(~null)
            if len(keep) < 2:
                continue
            t, doc, start, place = t.take(pa.array(keep)), doc[keep], start[keep], place[keep].astype(np.int64)
            column = t.column("bytes").combine_chunks()
            if isinstance(column, pa.ChunkedArray):
                column = pa.concat_arrays(column.chunks)
            anchor = t.column("anchor").to_numpy()
            group = np.cumsum(np.append(True, anchor[1:] != anchor[:-1]))
            offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            buf = np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]]
            base = offs[:-1] - offs[0]
            cell, j = repeats_in(buf, group, base, np.diff(offs) - length + 1, place, doc, start, length)
            yield pa.RecordBatch.from_arrays([pa.array(doc[cell]), pa.array((start[cell] + j).astype(np.int32)), pa.array(np.ones(len(cell), np.int16))], ["_d", "start", "windows"])

    n = C.shuffle_partitions(texts.sparkSession)
    key = F.when(F.col("bytes").isNull(), F.col("_d") * 31 + F.col("start")).otherwise(F.col("anchor"))
    return texts.repartition(n, key).sortWithinPartitions("anchor").mapInArrow(C.tidy(run), "_d long, start int, windows short")


def repeated_windows(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(_d, start, windows): runs of windows of `length` bytes in rows (_d, text) that also start earlier."""
    frequent = frequent_anchors(docs, length, k)
    found = C.stash(settle_cells(block_cells(docs, frequent, length, k), frequent), "cells")
    asked = found.where(F.col("kind") != REPEAT)
    late = settle_windows(asked_bytes(docs, asked, length), length)
    return found.where(F.col("kind") == REPEAT).select("_d", "start", "windows").unionByName(late)


def removed_bytes(n: int, start: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Mask of the bytes that the repeated windows cover."""
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, start, 1)
    np.add.at(edges, start.astype(np.int64) + windows + length - 1, -1)
    return np.cumsum(edges[:-1]) > 0


def strip_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, keep_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, text][, row]) for every row of docs.

    `row` is a struct of the columns `carry`, which travel with the text instead of being joined again.

    Each byte covered by a `length`-byte string that also starts earlier (smaller doc_id, or earlier in the document) goes; the
    strings are those of the input. Null text counts as empty. Rows equal in doc_id and text count as one document. `text`
    is what is left; bytes of characters that a cut has split are dropped from it (not from the digest). Other columns are
    not used. An empty input gives an empty result.
    """
    rows, names = numbered(docs)
    spans = repeated_windows(rows, length, k).groupBy("_d").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))  # bounded by the document
    columns = ["_d", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["text"] * keep_text + ["row"] * bool(carry)
    schema = "_d long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * keep_text
    whole = rows
    if carry:
        row = F.struct(*carry).alias("row")
        schema += f", row {docs.select(row).schema['row'].dataType.simpleString()}"
        if names is None:
            whole = docs.select(F.col("doc_id").cast("long").alias("_d"), F.col("text").cast("string").alias("text"), row)
        else:  # rows that are equal in doc_id and text share the first one's columns
            own = docs.select(F.col("doc_id").cast("long").alias("_i"), F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("_m"), row).groupBy("_i", "_m").agg(F.first("row").alias("row"))
            known = rows.join(names.select("_d", F.col("doc_id").alias("_n")), "_d").withColumn("_t", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
            whole = known.join(own, F.col("_n").eqNullSafe(F.col("_i")) & (F.col("_t") == F.col("_m")), "left").select("_d", "text", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in C.text_chunks(batch):
                out: list[tuple] = []
                lists = part.column("spans")
                for i in range(part.num_rows):
                    raw = buf[offs[i] : offs[i + 1]]
                    n, removed, runs = len(raw), 0, 0
                    if lists[i].is_valid:
                        flat = lists[i].values
                        gone = removed_bytes(n, flat.field(0).to_numpy(), flat.field(1).to_numpy(), length)
                        removed = int(gone.sum())
                        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0
                        raw = raw[~gone]
                    left = raw.tobytes()
                    out.append((n, removed, runs, hashlib.sha256(left).hexdigest(), *([left.decode("utf-8", "ignore")] * keep_text)))
                values = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                extra = [part.column("row")] if carry else []
                yield pa.RecordBatch.from_arrays([part.column("_d"), *(pa.array(v, t) for v, t in zip(values, kinds, strict=False)), *extra], columns)

    joined = whole.join(spans.hint("merge"), "_d", "left")
    return named(joined.select("_d", "text", "spans", *["row"] * bool(carry)).mapInArrow(C.tidy(run), schema), names)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_repeats(C.table(spark, sf_dir, "documents"), keep_text=False)
