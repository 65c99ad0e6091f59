"""Helpers the training-data operators share: Arrow text buffers as numpy
arrays, vectorised span hashing, packed int arrays, scratch tables."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, scratch_path

#: the ASCII white space class [\x20\x09-\x0D]
WHITE = b" \t\n\x0b\x0c\r"
_MUL_1 = np.uint64(0x9E3779B97F4A7C15)
_MUL_2 = np.uint64(0xBF58476D1CE4E5B9)
_MUL_3 = np.uint64(0x94D049BB133111EB)
_PAD = 16


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it
    back: a lineage cut that survives lost executors and keeps column pruning."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``written``, in as many buckets of ``key`` as a shuffle has
    partitions: joins on the key then move the other side only."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, name)
    table = "t_" + path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").bucketBy(partitions(spark), key).option("path", path).saveAsTable(table)
    return spark.table(table)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def others(df: DataFrame, *used: str):
    """All columns but ``used`` packed into one struct, so that names can't clash."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in used]
    return (F.struct(*rest) if rest else F.struct(F.lit(True).alias("none"))).alias("row")


def schema(df: DataFrame, ddl: str) -> T.StructType:
    """The columns of ``df`` and those of a DDL string."""
    return T.StructType(df.schema.fields + T.StructType.fromDDL(ddl).fields)


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on after its
    task, and what its allocators keep would count against the next one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """``run`` (batches in, batches out) with ``release`` after its task."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty.
    The bytes end with a few zeros of padding, past the last offset."""
    big = pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary()
    column = column.cast(big)
    if column.null_count:
        column = column.fill_null("" if big == pa.large_string() else b"")
    n = len(column)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    out = np.zeros(last - first + _PAD, np.uint8)
    if last > first:
        out[: last - first] = np.frombuffer(data, np.uint8, last - first, first)
    return out, offsets - first


def text_chunks(batch: pa.RecordBatch, column: str, most: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` text bytes (one row at least)."""
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    part = np.cumsum(size) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
        yield batch.slice(a, b - a)


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (the splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * _MUL_2
    h = (h ^ (h >> np.uint64(27))) * _MUL_3
    return h ^ (h >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of every span ``data[start:start+length]``, eight bytes a
    step over all spans together.  ``data`` needs 8 bytes of padding."""
    lanes = np.ndarray((max(len(data) - 7, 0),), "<u8", data, 0, (1,))
    h = mix(lengths.astype(np.uint64) * _MUL_1 + np.uint64(seed))
    if not len(starts):
        return h
    at, left, rows = starts.astype(np.int64), lengths.astype(np.int64), None
    while True:
        word = lanes[np.minimum(at, len(lanes) - 1)]
        short = left < 8
        if short.any():
            word = np.where(short, word & ((np.uint64(1) << (np.clip(left, 0, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1)), word)
        if rows is None:
            h = mix(h ^ (word * _MUL_1))
        else:
            h[rows] = mix(h[rows] ^ (word * _MUL_1))
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        rows = more if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A copy with A-Z lower-cased."""
    return data + ((data - np.uint8(65) < 26).astype(np.uint8) << 5)


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true ``inside`` bytes within each text: starts, ends,
    and for each text the number of the first run (texts + 1 entries)."""
    n = int(offsets[-1])
    inside = inside[:n]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
