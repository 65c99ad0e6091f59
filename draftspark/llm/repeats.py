"""Exact substring dedup: maximal repeats from enhanced suffix arrays.

A suffix array over a whole corpus fits no machine, so the corpus is cut such
that equal substrings still meet.  Every ``length``-byte window picks a minimizer
(its ``GRAM``-byte string of lowest hash, the leftmost of equals), which depends
on the window's bytes alone.  Neighbouring windows with the same minimizer form
one string of fewer than ``2 * length`` bytes; strings are dealt to shards by
the hash of their minimizer, so all occurrences of a window meet in one shard.
First the blocks of documents send 32 bits of each distinct minimizer; only
strings whose minimizer occurs in two documents can repeat (equal bits of
different minimizers merely let a string through).  Then a block sends each of
those strings once, with its smallest and largest document, so a passage that a
third of the corpus shares does not swell a shard.

A shard sorts the suffixes of its strings, computes the common prefixes of
neighbours and scans them with a stack: each node of the common-prefix interval
tree of at least ``length`` bytes whose occurrences differ in the byte before
them (or where one has none) is a maximal repeat, and its group names all
occurrences with the smallest document among them.  Back in the blocks, an
occurrence in a larger document than that loses the repeat's bytes.

Texts are UTF-8 bytes and matches never cross documents.  Defined results: null
and empty texts are empty; a null ``doc_id`` has no smaller document and is
smaller than none, so its text stays whole and removes nothing elsewhere; rows
that share a ``doc_id`` do not remove each other's bytes.  An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

LENGTH = 50              # bytes of the shortest repeat
GRAM = 16                # bytes of a minimizer
BLOCK_BYTES = 8 << 20    # text of a block of documents (one document at least)
SHARD_BYTES = 8 << 20    # text whose strings make a shard, on average
_STEP = 2 << 20          # bytes worked on at once
_SUFFIXES = 1 << 18      # suffixes sorted at once


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(b"".join(np.int64(a.nbytes).tobytes() + np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpacked(data: bytes, *kinds) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind in kinds:
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


# --- strings of windows that share a minimizer ---------------------------------

def gram_hash(data: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """Hash of the GRAM bytes at each place; ``data`` needs GRAM bytes of padding."""
    lanes = np.ndarray((max(len(data) - 7, 0),), "<u8", data, 0, (1,))
    first, second = (lanes[at], lanes[8:][at]) if not isinstance(at, slice) else (lanes[at.start:at.stop], lanes[at.start + 8:at.stop + 8])
    return K.mix(first * np.uint64(0x9E3779B97F4A7C15) ^ K.mix(second + np.uint64(0x632BE59BD9B4E019)))


def window_strings(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, place of the minimizer in it) of the strings of all texts of a
    padded buffer; the strings of a text start with consecutive windows."""
    starts, places = [], []
    n, span = int(offsets[-1]), length - GRAM + 1
    for a in range(0, n, _STEP):
        # windows that start in this step, and the bytes that they cover
        b = min(a + _STEP, n - length + 1)
        if b <= a:
            break
        key = gram_hash(data, slice(a, b + length - GRAM))
        key = (key >> np.uint64(32) << np.uint64(32)) | np.arange(len(key), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: len(key) - (span - width)], key[span - width:])
        chosen = (key & np.uint64(0xFFFFFFFF)).astype(np.int64) + a
        at = np.arange(a, b)
        text_end = offsets[np.searchsorted(offsets, at, "right")]
        inside = at + length <= text_end
        head = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (text_end[1:] != text_end[:-1])]) & inside
        first = np.flatnonzero(head)
        starts.append(at[first])
        places.append(chosen[first] - at[first])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(places)


class Block:
    """A stored block of documents with the windows' strings in it."""

    def __init__(self, row: dict, length: int, n_shards: int):
        self.ids = np.array([i if i is not None else 0 for i in row["doc_ids"]], np.int64)
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        self.data = _text(row["data"], int(self.offsets[-1]))
        diffs, self.place = _unpacked(row["strings"], np.uint32, np.uint8)
        self.start, self.place = np.cumsum(diffs.astype(np.int64)), self.place.astype(np.int64)
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        # a string reaches to where the next one's last window begins, or to the end of its text
        size = self.offsets[self.doc + 1] - self.start
        size[:-1] = np.where(self.doc[1:] == self.doc[:-1], np.diff(self.start) + length - 1, size[:-1])
        self.size = size
        key = gram_hash(self.data, self.start + self.place)
        self.code = (key % np.uint64(n_shards) << np.uint64(32)) | (key >> np.uint64(32))
        self.codes, self.code_of = np.unique(self.code, return_inverse=True)
        self.cuts = np.searchsorted(self.codes >> np.uint64(32), np.arange(n_shards + 1, dtype=np.uint64))

    def minimizers(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each shard: 32 bits of the distinct minimizers, ascending, and
        whether two documents of the block have one."""
        low, high = np.full(len(self.codes), len(self.ids)), np.full(len(self.codes), -1)
        _, rank = np.unique(self.ids, return_inverse=True)
        np.minimum.at(low, self.code_of, rank[self.doc])
        np.maximum.at(high, self.code_of, rank[self.doc])
        for k in np.flatnonzero(np.diff(self.cuts)).tolist():
            own = slice(self.cuts[k], self.cuts[k + 1])
            yield k, (self.codes[own] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (low < high)[own]

    def keep(self, bits: list[dict] | None) -> None:
        """Go on with the strings of shared minimizers: distinct ones in a fixed
        order, with their smallest and largest document and occurrences."""
        shared = np.zeros(len(self.codes), bool)
        for row in bits or ():
            a, b = self.cuts[row["shard"]], self.cuts[row["shard"] + 1]
            shared[a:b] = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(b - a))
        some = shared[self.code_of]
        self.start, self.place, self.doc, self.size, self.code = (x[some] for x in (self.start, self.place, self.doc, self.size, self.code))
        name = K.hash_spans(self.data, self.start, self.size) ^ K.mix(self.code)
        _, first, self.string = np.unique(name, return_index=True, return_inverse=True)
        order = np.argsort(self.code[first], kind="stable")  # by shard
        number = np.empty(len(first), np.int64)
        number[order] = np.arange(len(first))
        self.first, self.string = first[order], number[self.string]
        self.sorted_ids, rank = np.unique(self.ids, return_inverse=True)
        self.low, self.high = np.full(len(first), len(self.ids)), np.full(len(first), -1)
        np.minimum.at(self.low, self.string, rank[self.doc])
        np.maximum.at(self.high, self.string, rank[self.doc])
        self.cuts = np.searchsorted(self.code[self.first] >> np.uint64(32), np.arange(len(self.cuts), dtype=np.uint64))

    def shards(self) -> Iterator[tuple[int, int, int]]:
        """Shard, and its first and last distinct string."""
        for k in np.flatnonzero(np.diff(self.cuts)).tolist():
            yield k, int(self.cuts[k]), int(self.cuts[k + 1])

    def packet(self, a: int, b: int) -> bytes:
        """The distinct strings from ``a`` to ``b`` and the documents that they
        name, no others: a block sends one to every shard."""
        own = self.first[a:b]
        named, number = np.unique(np.concatenate([self.low[a:b], self.high[a:b]]), return_inverse=True)
        low, high = number[:b - a], number[b - a:]
        return _packed(np.diff(self.sorted_ids[named], prepend=0), self.size[own].astype(np.uint8), self.place[own].astype(np.uint8), low.astype(np.uint32),
                       (high - low).astype(np.uint32), gather(self.data, self.start[own], self.size[own]))


def _text(data: bytes, n: int) -> np.ndarray:
    out = np.zeros(n + 32, np.uint8)
    out[:n] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(n, 1)), np.uint8)
    return out


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def documents_in_blocks(docs: DataFrame, text_col: str, id_col: str, length: int) -> DataFrame:
    """The stored blocks: block, doc_ids, offsets, data (compressed), strings
    (their starts and minimizers' places), n_bytes.  They are written in buckets
    by block, so that what comes back to a block meets it without moving texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in K.text_chunks(batch, "text", BLOCK_BYTES):
                data, offsets = K.utf8(part.column("text"))
                data = np.concatenate([data, np.zeros(32, np.uint8)])
                start, place = window_strings(data, offsets, length)
                named = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)[np.searchsorted(offsets, start, "right") - 1]
                start, place = start[named], place[named]
                yield pa.RecordBatch.from_pylist([{
                    "block": f"{task}-{n}", "doc_ids": part.column("doc_id").to_pylist(), "offsets": K.pack(offsets),
                    "data": zstandard.ZstdCompressor(3).compress(data[: offsets[-1]].tobytes()),
                    "strings": _packed(np.diff(start, prepend=0).astype(np.uint32), place.astype(np.uint8)), "n_bytes": int(offsets[-1])}], schema)
                n += 1

    schema = pa.schema([("block", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.binary()), ("data", pa.binary()), ("strings", pa.binary()), ("n_bytes", pa.int64())])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return K.bucketed(rows.mapInArrow(K.tidy(run), "block string, doc_ids array<long>, offsets binary, data binary, strings binary, n_bytes long"), "blocks", "block")


# --- the suffix array of one shard ----------------------------------------------

def suffix_order(data: np.ndarray, at: np.ndarray, left: np.ndarray, width: int, head: np.ndarray | None = None, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix with the previous suffix) of suffixes of at most
    ``width`` bytes: ``left`` bytes from ``at``.  ``data`` needs padding.  With
    ``head``, the number of the class of a suffix's first ``skip`` bytes, classes
    follow one another in any order and only the bytes behind are compared;
    prefixes shorter than ``skip`` count as zero."""
    lanes = np.ndarray((max(len(data) - 7, 0),), ">u8", data, 0, (1,))
    columns = -(-(width - skip) // 8)
    keys = np.empty((columns, len(at)), np.uint64)
    for c in range(columns):
        rest = np.clip(left - skip - 8 * c, 0, 8)
        word = lanes[np.minimum(at + skip + 8 * c, len(lanes) - 1)].astype(np.uint64)
        cut = (np.uint64(64) - rest.astype(np.uint64) * np.uint64(8)) & np.uint64(63)
        keys[c] = np.where(rest == 0, 0, word >> cut << cut)
    order = np.lexsort((left, *keys[::-1]) if head is None else (left, *keys[::-1], head))
    keys, left = keys[:, order], left[order]
    common = np.zeros(len(at), np.int64)
    open_ = np.ones(max(len(at) - 1, 0), bool) if head is None else head[order][1:] == head[order][:-1]
    common[1:] = np.where(open_, skip, 0)
    for c in range(columns):
        differ = keys[c, 1:] ^ keys[c, :-1]
        # leading zero bytes of the difference, 8 if there is none
        lead = np.full(len(differ), 8, np.int64)
        for byte in range(7, -1, -1):
            lead[(differ >> np.uint64(56 - 8 * byte) & np.uint64(255)) != 0] = byte
        common[1:] += np.where(open_, lead, 0)
        open_ &= lead == 8
    if len(at):
        common[1:] = np.minimum(common[1:], np.minimum(left[1:], left[:-1]))
    return order, common


def _classes(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of the ``length`` bytes at each place, size of its class); a class
    that a hash made of different bytes is told apart by another hash."""
    for seed in range(8):
        _, first, which, count = np.unique(K.hash_spans(data, at, np.full(len(at), length), seed), return_index=True, return_inverse=True, return_counts=True)
        lanes = np.ndarray((max(len(data) - 7, 0),), "<u8", data, 0, (1,))
        like, same = at[first][which], True
        for c in [*range(0, length - 7, 8), length - 8]:
            same = same and bool((lanes[at + c] == lanes[like + c]).all())
        if same:
            break
    return which, count[which]


def maximal_repeats(common: np.ndarray, before: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, end) in suffix order of every node of the common-prefix
    interval tree of at least ``least`` bytes with diverse left extensions:
    one stack scan.  ``before`` is the byte before each suffix, -1 for none."""
    n = len(common)
    # a node's left extensions are diverse if two neighbours in it differ, or one has none
    change = np.zeros(n, bool)
    change[1:] = (before[1:] != before[:-1]) | (before[1:] < 0) | (before[:-1] < 0)
    changes = np.cumsum(change)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], common >= least, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        run = common[a:b]
        if (run == run[0]).all():  # a single node
            if changes[b - 1] > changes[a - 1]:
                yield int(run[0]), a - 1, b
            continue
        stack: list[tuple[int, int]] = []
        for i, length in enumerate([*run.tolist(), 0], a):
            first = i - 1
            while stack and stack[-1][0] > length:
                long, first = stack.pop()
                if changes[i - 1] > changes[first]:
                    yield long, first, i
            if length >= least and (not stack or stack[-1][0] < length):
                stack.append((length, first))


def shard_repeats(strings: pd.DataFrame, length: int) -> pd.DataFrame:
    """For each block the occurrences of repeats in its strings whose smallest
    document is smaller than the string's largest one: number of the string in
    the packet, start and bytes of the repeat in it, and that document."""
    packets, data, size, place, low, high = [], [], [], [], [], []
    for k, packet in enumerate(strings["packet"]):
        ids, n, p, lo, more, raw = _unpacked(packet, np.int64, np.uint8, np.uint8, np.uint32, np.uint32, np.uint8)
        ids = np.cumsum(ids)
        packets.append(np.full(len(n), k))
        data.append(raw)
        size.append(n.astype(np.int64))
        place.append(p.astype(np.int64))
        low.append(ids[lo])
        high.append(ids[lo + more])
    counts = [len(s) for s in size]
    packet, size, place, low, high = (np.concatenate(x) for x in (packets, size, place, low, high))
    number = np.arange(len(size)) - np.repeat(np.cumsum(counts) - counts, counts)
    data = np.concatenate([*data, np.zeros(128, np.uint8)])
    start = np.cumsum(size) - size
    key = gram_hash(data, start + place)
    # strings by minimizer; those of one document alone need no look
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(order))))
    shared = (np.minimum.reduceat(low[order], head) < np.maximum.reduceat(high[order], head))[group]
    order, group = order[shared], group[shared]
    out = []
    # minimizers with one text only: the text is the repeat
    name = K.hash_spans(data, start[order], size[order])
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(order) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(order)))
    single = (np.minimum.reduceat(name, head) == np.maximum.reduceat(name, head)) if len(order) else np.zeros(0, bool)
    if single.any():
        least = np.minimum.reduceat(low[order], head)
        one = np.repeat(single, count)
        out.append((order[one], np.zeros(int(one.sum()), np.int64), size[order[one]], np.repeat(least, count)[one]))
        order, group = order[~one], group[~one]
    if len(order):
        windows = size[order] - length + 1
        ends = np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1
        done, a = np.cumsum(windows)[ends - 1], 0
        while a < len(order):  # whole minimizer groups, as many as are sorted at once
            base = done[np.searchsorted(ends, a, "right") - 1] if a else 0
            last = int(np.searchsorted(done, base + _SUFFIXES, "right")) - 1
            b = int(ends[max(last, np.searchsorted(ends, a, "right"))])
            out.append(_repeats_of(data, start, size, low, order[a:b], length))
            a = b
    if not out:
        return pd.DataFrame({"block": [], "found": []})
    string, at, long, least = (np.concatenate(x) for x in zip(*out, strict=True))
    useful = least < high[string]
    string, at, long, least = string[useful], at[useful], long[useful], least[useful]
    rows = []
    by = np.argsort(packet[string], kind="stable")
    cuts = np.searchsorted(packet[string][by], np.arange(len(strings) + 1))
    for k, block in enumerate(strings["block"]):
        mine = by[cuts[k]:cuts[k + 1]]
        if len(mine):
            rows.append({"block": block, "found": _packed(number[string[mine]].astype(np.uint32), at[mine].astype(np.uint8), long[mine].astype(np.uint8), least[mine])})
    return pd.DataFrame(rows, columns=["block", "found"])


def _repeats_of(data, start, size, low, strings, length):
    """Occurrences (string, start, bytes, smallest document) of the maximal
    repeats among some strings; equal strings are one text."""
    name = K.hash_spans(data, start[strings], size[strings])
    _, first, text = np.unique(name, return_index=True, return_inverse=True)
    own = strings[first]
    smallest = np.full(len(own), np.iinfo(np.int64).max)
    np.minimum.at(smallest, text, low[strings])
    # a text is its own repeat where several documents have it whole
    members = np.argsort(text, kind="stable")
    member_cut = np.searchsorted(text[members], np.arange(len(own) + 1))
    windows = size[own] - length + 1
    which = np.repeat(np.arange(len(own)), windows)
    at = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin, left = start[own][which] + at, size[own][which] - at
    # a window that occurs once is in no repeat
    head, count = _classes(data, begin, length)
    twice = count > 1
    which, at, begin, left, head = which[twice], at[twice], begin[twice], left[twice], head[twice]
    order, common = suffix_order(data, begin, left, int(size[own].max()), head, length)
    before = np.where(at > 0, data[begin - 1].astype(np.int64), -1)[order]
    which, at, doc = which[order], at[order], smallest[which[order]]
    found_text, found_at, found_long, found_least = [np.arange(len(own))], [np.zeros(len(own), np.int64)], [size[own]], [smallest]
    firsts, ends, longs = [], [], []
    for long, a, b in maximal_repeats(common, before, length):
        firsts.append(a)
        ends.append(b)
        longs.append(long)
    if firsts:
        firsts, ends = np.array(firsts), np.array(ends)
        n = ends - firsts
        place = np.arange(n.sum()) + np.repeat(firsts - (np.cumsum(n) - n), n)
        least = np.repeat(np.minimum.reduceat(doc[place], np.cumsum(n) - n), n)
        found_text.append(which[place])
        found_at.append(at[place])
        found_long.append(np.repeat(np.array(longs), n))
        found_least.append(least)
    text_, at_, long_, least_ = (np.concatenate(x) for x in (found_text, found_at, found_long, found_least))
    n = member_cut[text_ + 1] - member_cut[text_]
    member = members[np.arange(n.sum()) + np.repeat(member_cut[text_] - (np.cumsum(n) - n), n)]
    return strings[member], np.repeat(at_, n), np.repeat(long_, n), np.repeat(least_, n)


# --- the job -----------------------------------------------------------------------

def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, spans (removed byte runs,
    start and end) and kept (the remaining bytes)."""
    blocks = documents_in_blocks(docs, text_col, id_col, length)
    n_shards = max(1, -(-(blocks.agg(F.sum("n_bytes")).first()[0] or 0) // SHARD_BYTES))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block]]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield row, Block(row, length, n_shards)

    def send_minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in rows_of(batches):
            for shard, fingerprints, twice in block.minimizers():
                packet = _packed(np.diff(fingerprints, prepend=np.uint32(0)), np.packbits(twice))
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([row["block"]]), pa.array([packet], pa.binary())], ["shard", "block", "packet"])

    def send_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in rows_of(batches):
            block.keep(row["shared"])
            for shard, a, b in block.shards():
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([row["block"]]), pa.array([block.packet(a, b)], pa.binary())], ["shard", "block", "packet"])

    def scan_minimizers(key, group: pd.DataFrame) -> pd.DataFrame:
        K.release()
        return group.assign(bits=shared_minimizers(group["packet"].tolist()))[["block", "shard", "bits"]]

    def scan_strings(key, group: pd.DataFrame) -> pd.DataFrame:
        K.release()
        return shard_repeats(group, length).assign(shard=key[0])[["block", "shard", "found"]]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in rows_of(batches):
            block.keep(row["shared"])
            yield _cut(block, row)

    sent = "shard long, block string, packet binary"
    shared = (blocks.drop("n_bytes").mapInArrow(K.tidy(send_minimizers), sent).groupBy("shard").applyInPandas(scan_minimizers, "block string, shard long, bits binary")
              .groupBy("block").agg(F.collect_list(F.struct("shard", "bits")).alias("shared")))
    ready = blocks.join(K.bucketed(shared, "shared", "block"), "block", "left")
    found = ready.mapInArrow(K.tidy(send_strings), sent).groupBy("shard").applyInPandas(scan_strings, "block string, shard long, found binary")
    answers = K.written(found, "repeats").groupBy("block").agg(F.collect_list(F.struct("shard", "found")).alias("answers"))
    return ready.join(answers, "block", "left").mapInArrow(K.tidy(cut), "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def shared_minimizers(packets: list[bytes]) -> list[bytes]:
    """For each packet of a shard, bits of its minimizers: whether two documents
    have one, in one block or in two."""
    prints, twice = [], []
    for packet in packets:
        diffs, flags = _unpacked(packet, np.uint32, np.uint8)
        prints.append(np.cumsum(diffs, dtype=np.uint32))
        twice.append(np.unpackbits(flags, count=len(diffs)).astype(bool))
    _, which, count = np.unique(np.concatenate(prints), return_inverse=True, return_counts=True)
    shared = (count[which] > 1) | np.concatenate(twice)
    cuts = np.cumsum([len(p) for p in prints])[:-1]
    return [K.pack(np.packbits(part)) for part in np.split(shared, cuts)]


def _cut(block: Block, row: dict) -> pa.RecordBatch:
    n = int(block.offsets[-1])
    change = np.zeros(n + 1, np.int32)
    answers = {a["shard"]: a["found"] for a in row["answers"] or ()}
    by_string = np.argsort(block.string, kind="stable")
    cuts = np.searchsorted(block.string[by_string], np.arange(len(block.first) + 1))
    doc_id = block.ids[block.doc]
    for shard, first, _ in block.shards():
        if shard in answers:
            number, at, long, least = _unpacked(answers[shard], np.uint32, np.uint8, np.uint8, np.int64)
            string = first + number.astype(np.int64)
            count = cuts[string + 1] - cuts[string]
            place = by_string[np.arange(count.sum()) + np.repeat(cuts[string] - (np.cumsum(count) - count), count)]
            at, long, least = (np.repeat(x, count) for x in (at.astype(np.int64), long.astype(np.int64), least))
            gone = least < doc_id[place]
            begin = block.start[place][gone] + at[gone]
            np.add.at(change, begin, 1)
            np.add.at(change, begin + long[gone], -1)
    removed = np.cumsum(change[:n]) > 0
    first, end, of_text = K.spans_of(removed, block.offsets)
    base = block.offsets[np.searchsorted(block.offsets, first, "right") - 1]
    span = pa.StructArray.from_arrays([pa.array(first - base), pa.array(end - base)], ["start", "end"])
    kept = block.data[:n][~removed].tobytes()
    kept_to = np.concatenate([[0], np.cumsum(~removed)])[block.offsets].tolist()
    texts = [kept[a:b] for a, b in zip(kept_to[:-1], kept_to[1:], strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(row["doc_ids"], pa.int64()), pa.array(np.diff(block.offsets)), pa.ListArray.from_arrays(pa.array(of_text.astype(np.int32)), span), pa.array(texts, pa.binary())],
        ["doc_id", "n_bytes", "spans", "kept"])
