"""MinHash near-dedup with circulant signatures, banding and exact Jaccard.

Two permutations of the 64-bit numbers make a whole signature: the first, sigma,
scatters the shingle hashes once; the second, pi, is applied circularly shifted,
so coordinate k of a document is the least ``pi(sigma(x) - k)`` over its shingles.
Both are invertible mixes, so they are permutations indeed, and no further random
functions are drawn.  ``tune`` picks bands that find a pair at the threshold with
probability ``RECALL``.  The job:

1. One pass gives each document its set size, a 128-bit digest of the set and
   its band keys.  Documents of equal sets are one node from here on.
2. A band key that two sets share is a bucket; buckets with the same members are
   one.  Every member is paired with one pivot of the bucket: as many pairs as
   members.  The shingles of the two meet in a join, the pivot's side copied to
   as many chunks as it has partners, and the exact Jaccard confirms a link.
3. Buckets whose members are not all connected by then are compared on: members
   outside of the bucket's largest component with all members of the others, in
   cells of bounded size.
4. Components over the links; of each the smallest document names it.

Words are maximal runs of characters other than ASCII white space, A-Z
lower-cased; shingles are ``WIDTH`` words and compared by 64-bit hashes.  Defined
results: fewer words give one shingle of all of them; null, empty and blank
texts have an empty set, are linked with nothing and name themselves; rows that
share a ``doc_id`` are linked on their own sets; a null ``doc_id`` never names a
component unless all its ids are null.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .graph import components
from .paragraphs import jaccard

WIDTH = 5
NUMERATOR, DENOMINATOR = 85, 100   # least similarity of a link
RECALL = 0.9999                    # of pairs at the threshold
CHUNK = 256                        # members of a bucket that meet in one cell
_WHITE = np.zeros(256, bool)
_WHITE[list(K.WHITE)] = True
_STEP = 1 << 15                    # shingles whose signature is worked on at once
_KEY_SEED = 0xA0761D6478BD642F


def tune(threshold: float, recall: float = RECALL, noise: float = 0.4, most_noise: float = 0.1) -> tuple[int, int]:
    """(bands, rows): the fewest rows whose bands find a pair at the threshold
    with probability ``recall`` and one of similarity ``noise`` with
    ``most_noise`` at most."""
    for rows in range(1, 33):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold ** rows)))
        if 1 - (1 - noise ** rows) ** bands <= most_noise:
            return bands, rows
    return bands, rows


BANDS, ROWS = tune(NUMERATOR / DENOMINATOR)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and
    where each text's begin (texts + 1 entries)."""
    n_texts = len(offsets) - 1
    low = K.lower_ascii(data)
    start, end, first = K.spans_of(~_WHITE[low[: int(offsets[-1])]], offsets)
    word = K.hash_spans(low, start, end - start)
    words = np.diff(first)
    n = np.where(words == 0, 0, np.maximum(words - width + 1, 1))
    of = np.repeat(np.arange(n_texts), n)
    at = np.arange(len(of)) + np.repeat(first[:-1] - (np.cumsum(n) - n), n)
    length = np.minimum(words, width)[of]
    shingle = K.mix(length.astype(np.uint64))
    word = np.concatenate([word, np.zeros(width, np.uint64)])
    for j in range(width):
        step = K.mix(shingle * np.uint64(3) + word[at + j])
        shingle = step if words.min(initial=width) >= width else np.where(j < length, step, shingle)
    order = np.lexsort((shingle, of))
    shingle, of = shingle[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (shingle[1:] != shingle[:-1])
    return shingle[new], np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=n_texts))])


def sigma(x: np.ndarray) -> np.ndarray:
    """The first permutation of the 64-bit numbers."""
    return K.mix(x * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x9E3779B97F4A7C15))


def pi(x: np.ndarray, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The second permutation, into ``out``."""
    np.right_shift(x, np.uint64(32), out=spare)
    np.bitwise_xor(x, spare, out=out)
    for mul in (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)):
        np.multiply(out, mul, out=out)
        np.right_shift(out, np.uint64(32), out=spare)
        np.bitwise_xor(out, spare, out=out)
    return out


def signatures(shingle: np.ndarray, first: np.ndarray, coordinates: int) -> np.ndarray:
    """(texts x coordinates): least ``pi(sigma(x) - k)`` of each set; empty sets give zeros."""
    out = np.zeros((len(first) - 1, coordinates), np.uint64)
    some = np.flatnonzero(np.diff(first))
    a = 0
    while a < len(some):  # whole sets, about _STEP shingles at once
        b = max(a + 1, int(np.searchsorted(first[some], first[some[a]] + _STEP)))
        b = min(b, len(some))
        own = some[a:b]
        x = sigma(shingle[first[own[0]]: first[own[-1] + 1]])
        head, hashed, spare = first[own] - first[own[0]], np.empty_like(x), np.empty_like(x)
        for k in range(coordinates):
            out[own, k] = np.minimum.reduceat(pi(x, hashed, spare), head)
            x -= np.uint64(1)
        a = b
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each text and band."""
    keys = np.empty((len(signature), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(signature), (band + 1) * _KEY_SEED & (1 << 64) - 1, np.uint64)
        for row in range(rows):
            key = K.mix(key * np.uint64(31) + signature[:, band * rows + row])
        keys[:, band] = key
    return keys


def _binary(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """One binary for each run of 64-bit values."""
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer((first * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def marked_sets(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """doc_id, mark (xxhash64 of the text), n (set size), node (16 bytes that
    stand for the set; null if empty) and keys (of the bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.text_chunks(batch, "text"):
                data, offsets = K.utf8(part.column("text"))
                shingle, first = shingle_sets(data, offsets)
                n = np.diff(first)
                digest = np.zeros((len(n), 2), np.uint64)
                for j, seed in enumerate((np.uint64(1), np.uint64(0x2545F4914F6CDD1D))):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(K.mix(shingle ^ seed))])
                    digest[:, j] = K.mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64))
                keys = band_keys(signatures(shingle, first, BANDS * ROWS), BANDS, ROWS)
                node = pa.array([d.tobytes() if k else None for d, k in zip(digest, n.tolist(), strict=True)], pa.binary())
                sizes = np.where(n > 0, BANDS, 0)
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(keys[n > 0].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(n), node, listed], ["doc_id", "mark", "n", "node", "keys"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    return rows.mapInArrow(K.tidy(run), "doc_id long, mark long, n long, node binary, keys array<long>")


def sets_of(docs: DataFrame, text_col: str) -> DataFrame:
    """(node, shingles) of rows that have a ``node``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.text_chunks(batch, "text"):
                shingle, first = shingle_sets(*K.utf8(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("node"), _binary(shingle, first)], ["node", "shingles"])

    return docs.select("node", F.col(text_col).alias("text")).mapInArrow(K.tidy(run), "node binary, shingles binary")


def similar(first: np.ndarray, shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of sets reach the threshold; sizes alone rule many out."""
    na, nb = np.diff(first)[a], np.diff(first)[b]
    hit = DENOMINATOR * np.minimum(na, nb) >= NUMERATOR * np.maximum(na, nb)
    at = np.flatnonzero(hit)
    if len(at):
        ratio = jaccard(first, shingles, a[at], b[at])
        total = (na + nb)[at]
        both = np.rint(ratio * total / (1 + ratio)).astype(np.int64)  # the intersection, as an integer again
        hit[at] = DENOMINATOR * both >= NUMERATOR * (total - both)
    return hit


def _runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = K.utf8(column)
    return raw[: int(offsets[-1])].view(np.uint64), offsets // 8


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the distinct pairs (a, b), those that are similar.  A side ``b`` with
    many partners is copied to as many chunks of them."""
    chunks = pairs.groupBy("b").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    chunks = K.written(chunks, "pivot-chunks")
    left = pairs.join(chunks, "b").withColumn("chunk", F.pmod(F.xxhash64("a"), F.col("chunks"))).join(sets, F.col("a") == F.col("node")).select("a", "b", "chunk", F.col("shingles").alias("sa"))
    right = chunks.join(sets, F.col("b") == F.col("node")).select(F.col("b").alias("b2"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk2"), F.col("shingles").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                a, fa = _runs(part.column("sa"))
                b, fb = _runs(part.column("sb"))
                n = part.num_rows
                hit = similar(np.concatenate([fa, fb[1:] + fa[-1]]), np.concatenate([a, b]), np.arange(n), np.arange(n) + n)
                yield part.select(["a", "b"]).filter(pa.array(hit))

    return left.join(right, (F.col("b") == F.col("b2")) & (F.col("chunk") == F.col("chunk2"))).select("a", "b", "sa", "sb").mapInArrow(K.tidy(run), "a binary, b binary")


def cells(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) across the components of buckets; ``members`` has key, node,
    label and main (in the largest component).  Pairs of which one is outside of
    the largest component meet in a cell of its bucket."""
    size = members.groupBy("key").agg(F.count("*").alias("all"), F.sum(F.when(F.col("main"), 0).otherwise(1)).alias("low"))
    size = size.select(F.col("key").alias("k"), F.ceil(F.col("all") / CHUNK).alias("rows"), F.ceil(F.col("low") / CHUNK).alias("sides"))
    dealt = members.join(size, F.col("key") == F.col("k")).withColumn("h", F.xxhash64("node", "key"))
    span = [F.sequence(F.lit(0).cast("long"), F.col(c) - 1) for c in ("rows", "sides")]
    low = dealt.where("NOT main").select("key", F.pmod("h", "sides").alias("side"), F.explode(span[0]).alias("cell"), "node", "label", F.lit(True).alias("left"))
    every = dealt.select("key", F.explode(span[1]).alias("side"), F.pmod("h", "rows").alias("cell"), "node", "label", F.lit(False).alias("left"))
    rows = low.unionByName(every).join(sets, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < 2 * CHUNK:
                continue
            last = _cell_cut(held)
            if last:  # whole cells only: the last one may go on
                yield from _judged(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from _judged(held)

    n = K.partitions(rows.sparkSession)
    return rows.repartition(n, "key", "side", "cell").sortWithinPartitions("key", "side", "cell").mapInArrow(K.tidy(run), "a binary, b binary").distinct()


def _cells_of(rows: pa.Table) -> np.ndarray:
    """Where a new cell begins."""
    cols = [np.asarray(rows.column(c)) for c in ("key", "side", "cell")]
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)]))


def _cell_cut(rows: pa.Table) -> int:
    return int(_cells_of(rows)[-1])


def _judged(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links that join components, one for each that is joined: fewer than a cell has members."""
    rows = rows.combine_chunks()
    node, label, left = rows.column("node").to_pylist(), rows.column("label").to_pylist(), np.asarray(rows.column("left"))
    shingles, first = _runs(rows.column("shingles").combine_chunks())
    names = {x: i for i, x in enumerate(dict.fromkeys([*node, *label]))}
    node, label = np.array([names[x] for x in node]), np.array([names[x] for x in label])
    back = list(names)
    head = _cells_of(rows)
    for start, end in zip(head.tolist(), [*head[1:].tolist(), len(node)], strict=True):
        x, y = np.flatnonzero(left[start:end]) + start, np.flatnonzero(~left[start:end]) + start
        joined = {}
        for i in x.tolist():  # one member against those of other components, links found here counting at once

            def root(c):
                while joined.get(c, c) != c:
                    c = joined[c]
                return c

            own = root(label[i])
            apart = y[np.array([root(c) != own for c in label[y].tolist()], bool)] if len(y) else y
            hit = apart[similar(first, shingles, np.full(len(apart), i), apart)] if len(apart) else apart
            first_of = {}
            for j in hit.tolist():
                first_of.setdefault(root(label[j]), j)
            if first_of:
                joined.update(dict.fromkeys(first_of, own))
                yield pa.RecordBatch.from_arrays([pa.array([back[node[i]]] * len(first_of), pa.binary()), pa.array([back[node[j]] for j in first_of.values()], pa.binary())], ["a", "b"])


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, mark (xxhash64 of the text), n (set
    size), root (a set that names the component; null if empty) and
    component_id (its smallest doc_id)."""
    own = K.written(marked_sets(docs, text_col, id_col), "circulant-sets")
    entries = own.select("node", F.explode("keys").alias("key")).distinct()
    buckets = entries.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("pivot"), F.sum(F.pmod(F.xxhash64("node"), F.lit(1 << 31))).alias("s"), F.bit_xor(F.xxhash64("node")).alias("x")).where("size > 1")
    buckets = buckets.groupBy("size", "pivot", "s", "x").agg(F.min("key").alias("key")).select(F.col("key").alias("k"), "pivot")
    members = K.written(entries.join(buckets, F.col("key") == F.col("k")).select("key", "node", "pivot"), "circulant-buckets")
    # one row of each set that shares a bucket
    wanted = members.select("node").distinct()
    rows = own.join(wanted, "node").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("mark"))).alias("w"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    rows = rows.select("node", F.col("w.id").alias("own_id"), F.col("w.mark").alias("own_mark"))
    picked = texts.join(rows, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark")))
    sets = K.written(sets_of(picked, "text").dropDuplicates(["node"]), "circulant-shingles")

    pairs = members.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    edges = K.written(confirmed(K.written(pairs, "circulant-pairs"), sets), "circulant-links")
    roots = components(edges)
    labelled = members.join(roots.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"), "left").select("key", "node", F.coalesce("root", "node").alias("label"))
    by_key = labelled.groupBy("key", "label").count()
    chief = by_key.groupBy("key").agg(F.max(F.struct("count", "label")).alias("c"), F.count("*").alias("parts")).where("parts > 1").select(F.col("key").alias("k"), F.col("c.label").alias("chief"))
    open_ = K.written(labelled.join(chief, F.col("key") == F.col("k")).select("key", "node", "label", (F.col("label") == F.col("chief")).alias("main")), "circulant-open")
    if not open_.isEmpty():
        edges = K.written(edges.unionByName(cells(open_, sets)), "circulant-links")
        roots = components(edges)

    low = own.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"))
    rooted = K.written(low.join(roots.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"), "left").select("node", "low", F.coalesce("root", "node").alias("root")), "circulant-rooted")
    names = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.select("node", "root").join(names, "root")
    linked = own.where("n > 0").join(named, "node").select("doc_id", "mark", "n", "root", "component_id")
    return linked.unionByName(own.where("n = 0").select("doc_id", "mark", "n", F.lit(None).cast("binary").alias("root"), F.col("doc_id").alias("component_id")))
