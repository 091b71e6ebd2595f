"""Shared plumbing of the training-data operators: tables, shared scratch, Arrow text chunks, 64-bit hashing."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy pass works on; a longer single text is still taken whole.
CHUNK_BYTES = 1 << 19


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of long texts, unless the session has bounds of its own."""
    for key, usual, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1500"), ("spark.sql.execution.arrow.maxBytesPerBatch", None, str(8 << 20))):
        try:
            if usual is None or spark.conf.get(key, usual) == usual:
                spark.conf.set(key, value)
        except Exception as error:  # a Spark version without the setting
            if "CANNOT_MODIFY_CONFIG" not in str(error):
                raise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder the cluster shares, from spark.checkpoint.dir; a temporary one only where it is unset in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = spark.conf.get("spark.barograph.localScratch", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="barograph-")
        spark.conf.set("spark.barograph.localScratch", path)
    return path


_written: list[str] = []


def stash(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in the order of stashes, for discard()."""
    return len(_written)


def discard(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Deletes the tables stashed from mark() `since` on but for the last `keep`: for when only those are still read."""
    gone = _written[since : len(_written) - keep]
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _written.remove(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- Arrow text -----------------------------------------------------------------------------------------------------


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about `limit` bytes of text each: (rows, bytes, offsets)."""
    if not batch.num_rows:
        return
    buf, offs = text_buffers(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo), buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def tidy(run):
    """run, with the memory that its task has freed given back when it ends: idle workers stay small."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def array_of(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the number of values in each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


# --- hashing --------------------------------------------------------------------------------------------------------

_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_LOWER = np.arange(256).astype(np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes; span_hashes() gives those of any span from them. Texts can be built to collide: what
    is found equal by them must be verified."""
    up, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


#: Spans of more bytes than this are digested one by one by blake2b instead of lane by lane.
LONG_SPAN = 256
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)


def lanes(buf: np.ndarray) -> np.ndarray:
    """A view of the eight bytes from each place on, zeros behind the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", buffer=padded, strides=(1,))


def span_digests(view: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit digests of the spans [start, end) of buf, whose lanes() are `view`: a non-linear mix lane by lane, so that no text
    is built to collide as with a polynomial; two salts give independent digests."""
    size = end - start
    out = mix(size.astype(np.uint64) + _U((salt * 0x9E3779B97F4A7C15 + 0x5851F42D4C957F2D) % (1 << 64)))
    live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    step = 0
    while len(live):
        left = size[live] - step
        out[live] = mix(out[live] ^ (view[start[live] + step] & _MASKS[np.minimum(left, 8)])) + out[live]
        step += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8, key=salt.to_bytes(8, "little")).digest(), "little")
    return out


def same_spans(view: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether the spans [start, end) and [other, other_end) hold the same bytes."""
    size = end - start
    equal = size == other_end - other
    live = np.flatnonzero(equal & (start != other))
    step = 0
    while len(live):
        if step > LONG_SPAN:
            for i in live.tolist():
                equal[i] = np.array_equal(buf[start[i] : end[i]], buf[other[i] : other_end[i]])
            break
        left = size[live] - step
        equal[live] = ((view[start[live] + step] ^ view[other[live] + step]) & _MASKS[np.clip(left, 0, 8)]) == 0
        step += 8
        live = live[(left > 8) & equal[live]]
    return equal


def lowered(buf: np.ndarray) -> np.ndarray:
    """buf with A-Z in lower case."""
    return _LOWER[buf]


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the maximal runs without ASCII white space, and the row each lies in. No span crosses rows."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~WHITE[buf]
    begins = np.zeros(len(buf) + 1, bool)
    begins[offs] = True
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | begins[:-1]))
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | begins[1:])) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1
