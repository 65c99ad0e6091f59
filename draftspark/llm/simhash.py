"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints within ``k`` bits agree on at least one of ``k + 1`` bit blocks
(pigeonhole), so distinct fingerprints are dealt out by block and block value;
a bucket that is still large is dealt out again by blocks of its remaining bits,
at most four times, after which 20 free bits bound it.  Within a bucket the
fingerprints are sorted by Gray rank, so that neighbours differ in few bits, and
runs of eight form the nodes of a tree.  A node keeps the bit pattern that all
its fingerprints share.  Pairs of nodes descend together; the differences in
their shared bits are a lower bound that only grows on the way down, and a pair
of nodes is pruned with all its members once it exceeds ``k``.  Nodes whose
members are all within ``k`` bits are linked through their first members, so a
dense group gives as many links as members, not pairs.

Words are maximal runs of characters other than ASCII white space; shingles are
``width`` words, space-joined.  Defined results: no words (null, empty or blank
text) gives fingerprint zero, linked like any other; fewer words than a shingle
give one shingle; rows that share a ``doc_id`` are linked on their own
fingerprints; a null ``doc_id`` never names a component unless all its ids are
null.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .graph import components

WIDTH, BITS = 3, 3        # words of a shingle, most differing bits of a link
BUCKET = 20_000           # distinct fingerprints of a bucket that is dealt no further
FAN = 8                   # members of a node
_PAIRS = 1 << 19          # node pairs worked on at once
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle of one text, repeats included."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= width:
        return np.array([digest(line, 42)], np.uint64)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[: len(tokens) - width + 1].tolist(), ends[width - 1:].tolist(), strict=True)),
                       np.uint64, len(tokens) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; zero without hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 15):
        part = hashes[a: a + (1 << 15)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """(doc_id, mark, fp): mark is xxhash64 of the text, fp the 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.text_chunks(batch, "text"):
                data, offsets = K.utf8(part.column("text"))
                raw, cut = data.tobytes(), offsets.tolist()
                fp = [fingerprint(shingle_hashes(raw[a:b], width)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "mark", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text")).mapInArrow(
        K.tidy(run), "doc_id long, mark long, fp long")


# --- dealing fingerprints out ------------------------------------------------

def block_masks(fixed: int, parts: int) -> list[int]:
    """The bits outside ``fixed`` cut into ``parts`` even blocks, each joined to ``fixed``."""
    free = [i for i in range(64) if not fixed >> i & 1]
    cuts = [len(free) * p // parts for p in range(parts + 1)]
    return [fixed | sum(1 << i for i in free[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def buckets(distinct: DataFrame, bits: int) -> DataFrame:
    """(mask, value, fp): fingerprints by shared block; each pair within
    ``bits`` shares at least one (mask, value)."""
    rows, masks, ready = distinct.withColumn("mask", F.lit(0).cast("long")), [0], None
    for depth in range(4):
        below = {m: block_masks(m, bits + 1) for m in masks}
        table = F.create_map(*[x for m, subs in below.items() for x in (F.lit(_long(m)), F.array(*[F.lit(_long(s)) for s in subs]))])
        rows = rows.select("fp", F.explode(table[F.col("mask")]).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        masks = sorted({s for subs in below.values() for s in subs})
        if depth:
            rows = rows.distinct()
        hot = K.written(rows.groupBy("mask", "value").count().where(F.col("count") > BUCKET).drop("count"), "hot-buckets")
        last = depth == 3 or hot.isEmpty()
        cool = rows if last else rows.join(hot, ["mask", "value"], "left_anti")
        ready = cool if ready is None else ready.unionByName(cool)
        if last:
            return ready
        rows = rows.join(hot, ["mask", "value"], "left_semi").select("fp", "mask")


# --- the index of the buckets in one task -------------------------------------

def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each bit pattern in the reflected Gray sequence."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def build_tree(fp: np.ndarray, sizes: np.ndarray) -> list[dict]:
    """Levels of the forest over consecutive runs of ``sizes`` fingerprints (one
    tree a run), leaves first: for each node the bits its members share, their
    pattern there, and its children in the level below."""
    level = {"shared": np.full(len(fp), _ONES), "pattern": fp, "from": np.arange(len(fp)), "to": np.arange(len(fp)) + 1, "first": np.arange(len(fp)), "last": np.arange(len(fp)) + 1}
    levels, sizes = [level], sizes.copy()
    low, high = fp, fp
    while sizes.max(initial=0) > 1:
        up = -(-sizes // FAN)
        base = np.cumsum(sizes) - sizes
        node_run = np.repeat(np.arange(len(sizes)), up)
        place = np.arange(len(node_run)) - np.repeat(np.cumsum(up) - up, up)
        start = base[node_run] + place * FAN
        end = np.minimum(start + FAN, (base + sizes)[node_run])
        low, high = np.bitwise_and.reduceat(low, start), np.bitwise_or.reduceat(high, start)
        shared = ~(low ^ high)
        levels.append({"shared": shared, "pattern": low & shared, "from": start, "to": end, "first": levels[-1]["first"][start], "last": levels[-1]["last"][end - 1]})
        sizes = up
    return levels


def _expand(a: np.ndarray, b: np.ndarray, level: dict) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a child of a and a child of b; for a == b each pair once."""
    na, nb = level["to"][a] - level["from"][a], level["to"][b] - level["from"][b]
    n = na * nb
    which = np.repeat(np.arange(len(a)), n)
    k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    x, y = level["from"][a][which] + k // nb[which], level["from"][b][which] + k % nb[which]
    keep = (a != b)[which] | (x <= y)
    return x[keep], y[keep]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the two ends of every link the same, smallest label."""
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label[:] = jump


def link(fp: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """Label of each fingerprint (a member's index) after linking all within
    ``bits`` in each run; runs are sorted by Gray rank."""
    levels, label = build_tree(fp, sizes), np.arange(len(fp))
    top = levels[-1]
    roots = np.arange(len(top["first"]))
    work = [(len(levels) - 1, roots[i: i + _PAIRS // FAN ** 2], roots[i: i + _PAIRS // FAN ** 2]) for i in range(0, len(roots), _PAIRS // FAN ** 2)]
    while work:
        depth, a, b = work.pop()
        if depth == 0:
            merge(label, a, b)
            continue
        x, y = _expand(a, b, levels[depth])
        if depth == 1:
            x, y = x[label[x] != label[y]], y[label[x] != label[y]]
        level = levels[depth - 1]
        both = level["shared"][x] & level["shared"][y]
        apart = np.bitwise_count((level["pattern"][x] ^ level["pattern"][y]) & both)
        near = apart <= bits
        x, y, apart, both = x[near], y[near], apart[near], both[near]
        if depth > 1:  # all members of both within the distance: link through the first ones
            dense = apart + np.bitwise_count(~both) <= bits
            for nodes, other in ((x[dense], y[dense]), (y[dense], x[dense])):
                n = level["last"][nodes] - level["first"][nodes]
                member = np.repeat(level["first"][nodes], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                merge(label, member, np.repeat(level["first"][other], n))
            x, y = x[~dense], y[~dense]
        step = _PAIRS // FAN ** 2 if depth > 1 else max(len(x), 1)
        work += [(depth - 1, x[i: i + step], y[i: i + step]) for i in range(0, len(x), step)]
    return label


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b) fingerprints: a spanning forest of the links of each bucket."""
    dealt = buckets(distinct, bits)
    n = K.partitions(dealt.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush(rows: pa.Table) -> pa.RecordBatch:
            mask, value, fp = (np.asarray(rows.column(c)) for c in ("mask", "value", "fp"))
            fp = fp.view(np.uint64)
            head = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]))
            sizes = np.diff(np.append(head, len(fp)))
            many = np.repeat(sizes > 1, sizes)
            fp, sizes = fp[many], sizes[sizes > 1]
            order = np.lexsort((gray_rank(fp), np.repeat(np.arange(len(sizes)), sizes)))
            fp = fp[order]
            label = link(fp, sizes, bits)
            tied = np.flatnonzero(label != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[tied].view(np.int64)), pa.array(fp[label[tied]].view(np.int64))], ["a", "b"])

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= 1 << 17:  # whole buckets only: the last one may go on
                rows = pa.Table.from_batches(held)
                mask, value = np.asarray(rows.column("mask")), np.asarray(rows.column("value"))
                cut = int(np.flatnonzero((mask != mask[-1]) | (value != value[-1]))[-1]) + 1 if (mask[0], value[0]) != (mask[-1], value[-1]) else 0
                if cut:
                    yield flush(rows.slice(0, cut))
                held, count = rows.slice(cut).to_batches(), rows.num_rows - cut
        if count:
            yield flush(pa.Table.from_batches(held))

    return dealt.repartition(n, "mask", "value").sortWithinPartitions("mask", "value").mapInArrow(K.tidy(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH, bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, mark (xxhash64 of the text), fp
    (long), root (a fingerprint that names the component) and component_id (its
    smallest doc_id)."""
    own = K.written(fingerprints(docs, text_col, id_col, width), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("low"))
    tied = components(links(distinct.select("fp"), bits))
    rooted = distinct.join(tied, distinct.fp == tied.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = K.written(rooted, "rooted")
    names = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return own.join(rooted.select("fp", "root").join(names, "root"), "fp").select("doc_id", "mark", "fp", "root", "component_id")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH, bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (of equal
    ids the smallest text hash, of equal rows any one).  What has to go, or is
    there more than once, is written without texts and of known size, so that the
    texts move only where that is too much to broadcast, and then once."""
    found = K.written(near_duplicates(docs, text_col, id_col, width, bits).select("doc_id", "mark", "root"), "near-marks")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("mark"))).alias("w")).select(F.col("root").alias("of"), F.col("w.id").alias("best_id"), F.col("w.mark").alias("best_mark"))
    kept = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("mark") == F.col("best_mark"))
    each = found.groupBy("root", "doc_id", "mark").agg(F.count("*").alias("rows")).join(best, F.col("root") == F.col("of")).withColumn("kept", kept)
    odd = K.written(each.where("NOT kept OR rows > 1").select(F.col("doc_id").alias("_odd_id"), F.col("mark").alias("_odd_mark"), "kept"), "near-odd")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col)).alias("_mark"))
    same = F.col("_id").eqNullSafe(F.col("_odd_id")) & (F.col("_mark") == F.col("_odd_mark"))
    out, twins = rows.join(odd, same, "left_anti"), odd.where("kept")
    if not twins.isEmpty():
        out = out.unionByName(rows.join(twins, same, "left_semi").dropDuplicates(["_id", "_mark"]))
    return out.select("row.*")
