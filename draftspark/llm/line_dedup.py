"""Line dedup with sharded minimal perfect hashing.

Every distinct line key gets a 128-bit hash.  Keys are dealt to shards of a
bounded number of distinct keys; each shard stores a minimal perfect hash (a
cascade of bit arrays: keys alone in their slot of a level stay there, the rest
go on to the next level) that indexes three compact arrays: fingerprint,
document count and last document.  Documents' line hashes are routed to their
shard and probe the arrays; no join of lines with lines is made.

A shard whose lines are probed very often (one line in a third of all
documents) is copied to several tasks and its probes are dealt out over them;
the number of probes is known from the counts in the index.

Defined results: a null text counts as one empty line; a null ``doc_id`` is no
document of its own for the counts and never the last holder; rows that share a
``doc_id`` are one document.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K

SHARD_KEYS = 100_000     # distinct keys of one shard
TASK_PROBES = 400_000    # probes of one task of a shard
_LEVEL_LOAD = 0.6        # keys per slot in each level of the cascade


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """For each line its key (stripped, A-Z lower-cased), or None where the key
    has fewer than ``min_chars`` code points."""
    out: list[bytes | None] = []
    for line in text.lower().split(b"\n"):
        key = line.strip(K.WHITE)
        n = len(key)
        out.append(key if n >= min_chars and (n >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars) else None)
    return out


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, text_col: str, id_col: str, min_chars: int) -> DataFrame:
    """(doc_id, h1, h2) for each distinct key of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.text_chunks(batch, "text", 16 << 20):
                data, offsets = K.utf8(part.column("text"))
                raw, cut = data.tobytes(), offsets.tolist()
                found, count = [], np.zeros(part.num_rows, np.int64)
                for i in range(part.num_rows):
                    keys = {k for k in line_keys(raw[cut[i]:cut[i + 1]], min_chars) if k is not None}
                    count[i] = len(keys)
                    found += map(key_hash, keys)
                h = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
                ids = part.column("doc_id").take(pa.array(np.repeat(np.arange(part.num_rows), count)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(h[:, 0]), pa.array(h[:, 1])], ["doc_id", "h1", "h2"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        K.tidy(run), "doc_id long, h1 long, h2 long")


# --- the minimal perfect hash of a shard ------------------------------------

def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (K.mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)


def mph_build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes of the levels, bits of all levels) for distinct uint64 keys."""
    sizes, bits, rest = [], [], keys
    while len(rest):
        size = max(8, int(len(rest) / _LEVEL_LOAD))
        slot = _slots(rest, len(sizes), size)
        alone = np.bincount(slot, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        rest = rest[~alone[slot]]
    return np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool)


def mph_rank(sizes: np.ndarray, bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key, or -1 where no level has it (it is not a member)."""
    ranks = np.cumsum(bits) - bits
    out, rest, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes.tolist()):
        if not len(rest):
            break
        at = base + _slots(keys[rest], level, size)
        hit = bits[at]
        out[rest[hit]] = ranks[at[hit]]
        rest, base = rest[~hit], base + size
    return out


_INDEX = "shard long, seed long, n_keys long, n_probes long, sizes binary, bits binary, fingerprints binary, counts binary, last_docs binary"


def build_index(stats: DataFrame, n_keys: int) -> DataFrame:
    """One row per shard from (h1, h2, n_docs, last_doc): the perfect hash over
    the keys and, by its index, fingerprint (32 bits of ``h2``), number of
    documents and last document.  Should two keys of a shard mix to the same 64
    bits, the shard takes the next seed."""
    shards = max(1, -(-n_keys // SHARD_KEYS))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        seed = 0
        while len(np.unique(key := member_key(group["h1"].to_numpy(), group["h2"].to_numpy(), seed))) < len(group):
            seed += 1
        sizes, bits = mph_build(key)
        at = mph_rank(sizes, bits, key)
        prints, counts, last = np.zeros(len(key), np.uint32), np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        prints[at] = group["h2"].to_numpy().view(np.uint64).astype(np.uint32)
        counts[at] = group["n_docs"].to_numpy()
        last[at] = group["last_doc"].fillna(0).to_numpy()
        return pd.DataFrame([{
            "shard": int(group["shard"].iloc[0]), "seed": seed, "n_keys": len(key), "n_probes": int(group["n_docs"].sum()),
            "sizes": K.pack(sizes), "bits": K.pack(np.packbits(bits)), "fingerprints": K.pack(prints),
            "counts": K.pack(counts), "last_docs": K.pack(last)}])

    return stats.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard").applyInPandas(build, _INDEX)


def member_key(h1: np.ndarray, h2: np.ndarray, seed: int) -> np.ndarray:
    """The 64 bits that the perfect hash works on, mixed from all 128."""
    return K.mix(h1.view(np.uint64) ^ K.mix(h2.view(np.uint64) + np.uint64(seed)))


def probe(index: pd.DataFrame, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, last document) of each line hash; 0 documents if unknown."""
    row = index.iloc[0]
    sizes = np.frombuffer(row["sizes"], np.int64)
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: int(sizes.sum())].astype(bool)
    at = mph_rank(sizes, bits, member_key(h1, h2, int(row["seed"])))
    known = at >= 0
    known[known] = np.frombuffer(row["fingerprints"], np.uint32)[at[known]] == h2[known].view(np.uint64).astype(np.uint32)
    counts, last = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
    counts[known] = np.frombuffer(row["counts"], np.int64)[at[known]]
    last[known] = np.frombuffer(row["last_docs"], np.int64)[at[known]]
    return counts, last


def repeated_lines(docs: DataFrame, text_col: str, id_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, drops): for each document the hashes of the lines it loses."""
    lines = line_hashes(docs, text_col, id_col, min_chars)
    stats = K.written(lines.groupBy("h1", "h2").agg(
        F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc")), "line-stats")
    n_keys = stats.count()
    shards = max(1, -(-n_keys // SHARD_KEYS))
    index = K.written(build_index(stats, n_keys), "line-index")
    copies = index.select("shard", F.greatest(F.lit(1), F.ceil(F.col("n_probes") / TASK_PROBES)).cast("long").alias("copies"))
    routed = (lines.withColumn("shard", F.pmod("h1", F.lit(shards)))
              .join(copies.where("copies > 1"), "shard", "left")
              .withColumn("copy", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("copies")), F.lit(0))))
    arrays = index.join(copies, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = left["h1"].to_numpy(np.int64), left["h2"].to_numpy(np.int64)
        counts, last = probe(right, h1, h2)
        gone = (counts >= min_docs) & (left["doc_id"].isna().to_numpy() | (left["doc_id"].fillna(0).to_numpy(np.int64) != last))
        return left.loc[gone, ["doc_id", "h1"]]

    drops = routed.select("shard", "copy", "doc_id", "h1", "h2").groupBy("shard", "copy").cogroup(
        arrays.groupBy("shard", "copy")).applyInPandas(run, "doc_id long, h1 long")
    return drops.groupBy("doc_id").agg(F.collect_set("h1").alias("drops"))


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, text (kept lines joined by \\n),
    n_lines (before), n_dropped, and ``row`` with all other columns.  A key of
    at least ``min_chars`` code points in at least ``min_docs`` documents keeps
    its lines in the largest doc_id only."""
    drops = repeated_lines(docs, text_col, id_col, min_chars, min_docs).withColumnRenamed("doc_id", "_id")
    left = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), K.others(docs, id_col, text_col))
    joined = left.join(drops, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "drops", "row")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), left.schema["row"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.text_chunks(batch, "text", 16 << 20):
                data, offsets = K.utf8(part.column("text"))
                raw, cut = data.tobytes(), offsets.tolist()
                lost = part.column("drops").to_pylist()
                kept, n_lines, n_dropped = [], [], []
                for i, drop in enumerate(lost):
                    text = raw[cut[i]:cut[i + 1]]
                    n_lines.append(text.count(b"\n") + 1)
                    if drop:
                        drop = set(drop)
                        keep = [line for line, key in zip(text.split(b"\n"), line_keys(text, min_chars), strict=True)
                                if key is None or int.from_bytes(key_hash(key)[:8], "little", signed=True) not in drop]
                        n_dropped.append(n_lines[-1] - len(keep))
                        text = b"\n".join(keep)
                    else:
                        n_dropped.append(0)
                    kept.append(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()),
                     pa.array(n_dropped, pa.int64()), part.column("row")], ["doc_id", "text", "n_lines", "n_dropped", "row"])

    return joined.mapInArrow(K.tidy(run), schema)
