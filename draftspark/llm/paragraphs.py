"""Substring dedup of paragraphs: MinHash banding, exact Jaccard, components.

The unit compared is a paragraph: a line of ``SMALLEST`` to ``LONGEST`` words, or
a piece of a longer line.  A longer line is cut before those words that, with
the word before, hash lower than any other place at most ``REACH`` words away in
the line, and where a word begins or ends to repeat ``SMALLEST`` times or more.
A cut depends only on the words around it, so a passage copied into any line is
cut at the same places there.  No cut lies closer than ``REACH + 1`` words to
another one or to an end of the line: a longer line is compared whole, nothing
of it is left out.  Shingles are runs of ``WIDTH`` words.  ``tune`` picks the
cheapest bands whose recall at the threshold meets a target.  The job:

1. Blocks of documents send 32 bits of each paragraph's band keys and of its
   content; a key that two different contents share is a collision.
2. Colliding paragraphs go, with their shingles, to the task of the key; a key
   of very many paragraphs is dealt out in chunks, each with the same few pivots.
   A pair is judged in the first band where it collides: by exact Jaccard of the
   shingle sets.  Links are needed only between paragraphs that aren't
   connected yet: the members are compared with one of them, and of those left
   apart each with the others, so a dense group takes one round.
3. What chunks of one key left apart is compared across its chunks: all members
   outside of the key's largest component with all members of other components.
4. Components over exact copies (equal words) and links are the classes; of each
   class the paragraph of the smallest document stays.

Words are maximal runs of characters other than ASCII white space, A-Z
lower-cased.  A line that loses all its pieces goes with its line break; from any
other line the removed pieces go, each with the white space after it.  Defined
results: lines of fewer than ``SMALLEST`` words are not compared and stay; null and empty texts have no paragraphs and stay empty; a null ``doc_id`` takes
no part and its text stays whole; rows that share a ``doc_id`` don't remove each
other's paragraphs, but within a row only the first paragraph of a class stays.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K
from .graph import components
from .repeats import _packed, _text, _unpacked

WIDTH, THRESHOLD = 5, 0.8
RECALL = 0.999           # of pairs at the threshold
SMALLEST, LONGEST = 12, 32  # words of a line that is compared, and of one that isn't cut
REACH = 9                # words to either side that a cut looks at; pieces have more words than that
CHUNK, PIVOTS = 512, 16  # paragraphs of a key compared in one go; those that all its chunks get
BLOCK_BYTES = 8 << 20
SHARD_KEYS = 1 << 21     # band keys of a shard of the collision search, on average
_STEP = 2 << 20          # text bytes whose shingles are worked on at once
_WHITE = np.zeros(256, bool)
_WHITE[list(K.WHITE)] = True


def tune(threshold: float = THRESHOLD, recall: float = RECALL, noise: float = 0.3, most_noise: float = 0.15) -> tuple[int, int]:
    """(bands, rows): the fewest bands, then rows, that find a pair at the
    threshold with probability ``recall`` and a pair of similarity ``noise``
    with ``most_noise`` at most."""
    for rows in range(1, 33):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold ** rows)))
        if 1 - (1 - noise ** rows) ** bands <= most_noise:
            return bands, rows
    return bands, rows


BANDS, ROWS = tune()


# --- paragraphs of a block -------------------------------------------------------

def cuts(word: np.ndarray, line_of: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Before which words (hashes, with the numbers of their lines and the words
    of each line) a line of more than ``LONGEST`` words is cut."""
    out = np.zeros(len(word), bool)
    at = np.flatnonzero(count[line_of] > LONGEST)  # whole lines, so neighbours stay neighbours
    if not len(at):
        return out
    word, line = word[at], line_of[at]
    start = np.concatenate([[True], line[1:] != line[:-1]])
    height = K.mix(np.concatenate([word[:1], K.mix(word[:-1])]) ^ word)
    # places where a repeated word begins or ends are lower than all others
    new = np.concatenate([[True], word[1:] != word[:-1]]) | start
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(word)))
    long_ = size >= SMALLEST
    height[head[long_]] = 0
    after = (head + size)[long_]
    height[after[after < len(word)]] = 0
    place = np.arange(len(word)) - np.maximum.accumulate(np.where(start, np.arange(len(word)), 0))
    low = (place > REACH) & (count[line] - place > REACH)
    height[~low] = np.iinfo(np.uint64).max
    for step in range(1, REACH + 1):  # of equal ones the first
        same = line[step:] == line[:-step]
        low[:-step] &= ~(same & (height[step:] < height[:-step]))
        low[step:] &= ~(same & (height[:-step] <= height[step:]))
    out[at] = low
    return out


class Paragraphs:
    """Paragraphs of texts: text number, start and end (of the bytes that go with
    it), content hash, and if asked for sorted distinct shingles (runs) and band
    keys."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, shingles: bool = True):
        self._with = shingles
        parts = []
        n, text = len(offsets) - 1, 0
        while text < n:  # whole texts, about _STEP bytes at once
            last = max(text + 1, int(np.searchsorted(offsets, offsets[text] + _STEP, "right")) - 1)
            parts.append(self._read(data, offsets[text:last + 1], text))
            text = last
        if not parts:
            parts = [self._read(data, offsets, 0)]
        self.text, self.start, self.end, self.content, n_shingles, self.shingles, self.bands = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.first = np.concatenate([[0], np.cumsum(n_shingles)])

    def _read(self, data: np.ndarray, offsets: np.ndarray, base: int):
        a, b = int(offsets[0]), int(offsets[-1])
        own = np.concatenate([K.lower_ascii(data[a:b]), np.zeros(16, np.uint8)])
        offsets = offsets - a
        line_start, line_end, _ = K.spans_of(own[: b - a] != 10, offsets)
        start, end, _ = K.spans_of(~_WHITE[own[: b - a]], offsets)
        word = K.hash_spans(own, start, end - start)
        line_of = np.searchsorted(line_start, start, "right") - 1
        in_line = np.bincount(line_of, minlength=len(line_start))
        line_new = np.ones(len(word), bool)
        line_new[1:] = line_of[1:] != line_of[:-1]
        first = np.flatnonzero(line_new | cuts(word, line_of, in_line))
        count = np.diff(np.append(first, len(word)))
        # bytes of each paragraph: up to the next one of its line
        line = line_of[first]
        from_ = np.where(line_new[first], line_start[line], start[first])
        last = np.ones(len(first), bool)
        last[:-1] = line[1:] != line[:-1]
        to = np.where(last, line_end[line], np.append(from_[1:], 0)[: len(first)])
        some = np.flatnonzero(in_line[line] >= SMALLEST)
        first, count, from_, to = first[some], count[some], from_[some], to[some]
        # content hash of each paragraph's words, bound to their order
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at = place + np.repeat(first, count)
        total = np.concatenate([[np.uint64(0)], np.cumsum(K.mix(word[at] ^ K.mix(place.astype(np.uint64) + np.uint64(1))))])
        ends = np.cumsum(count)
        content = K.mix(total[ends] - total[ends - count] + count.astype(np.uint64))
        text = np.searchsorted(offsets, from_, "right") - 1 + base
        if not self._with:
            return text, from_ + a, to + a, content, np.zeros(len(some), np.int64), np.zeros(0, np.uint64), np.zeros((0, BANDS), np.uint64)
        # shingles: runs of WIDTH words within a paragraph
        n = count - WIDTH + 1
        at = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
        shingle = np.zeros(len(at), np.uint64)
        for j in range(WIDTH):
            shingle = K.mix(shingle * np.uint64(3) + word[at + j])
        bands = band_keys(shingle, np.cumsum(n) - n)
        of = np.repeat(np.arange(len(some)), n)
        order = np.lexsort((shingle, of))
        shingle, of = shingle[order], of[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (shingle[1:] != shingle[:-1])
        return text, from_ + a, to + a, content, np.bincount(of[new], minlength=len(some)), shingle[new], bands


def band_keys(shingle: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Band keys (paragraphs x BANDS) from the shingles of consecutive
    paragraphs that start at ``head``."""
    keys = np.zeros((len(head), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(head), band + 1, np.uint64)
        for row in range(ROWS):
            seed = (band * ROWS + row + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
            h = (shingle ^ np.uint64(seed)) * np.uint64(seed | 1)
            h ^= h >> np.uint64(32)
            if len(head):
                key = K.mix(key * np.uint64(31) + np.minimum.reduceat(h * np.uint64(0xD6E8FEB86659FD93), head))
        keys[:, band] = key
    return keys


class Block:
    """A stored block: its paragraphs, and the distinct contents among them."""

    def __init__(self, row: dict, n_shards: int = 0):
        """Without shards only what the contents need is worked out."""
        self.ids = row["doc_ids"]
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        self.data = _text(row["data"], int(self.offsets[-1]))
        self.p = Paragraphs(self.data, self.offsets, n_shards > 0)
        null = np.array([i is None for i in self.ids], bool)
        self.doc = np.array([i if i is not None else 0 for i in self.ids], np.int64)
        self.takes_part = ~null[self.p.text]
        content = self.p.content[self.takes_part]
        self.contents, first = np.unique(content, return_index=True)
        self.own = np.flatnonzero(self.takes_part)[first]  # one paragraph of each content
        self.low = np.full(len(self.contents), np.iinfo(np.int64).max)
        np.minimum.at(self.low, np.searchsorted(self.contents, content), self.doc[self.p.text[self.takes_part]])
        if not n_shards:
            return
        # entries: a key of a content, by shard and 32 bits of the key
        keys = self.p.bands[self.own].ravel()
        self.entry_key = (keys % np.uint64(n_shards) << np.uint64(32)) | (keys >> np.uint64(32))
        self.order = np.argsort(self.entry_key, kind="stable")
        self.cuts = np.searchsorted(self.entry_key[self.order] >> np.uint64(32), np.arange(n_shards + 1, dtype=np.uint64))

    def entries(self) -> Iterator[tuple[int, np.ndarray]]:
        """Shard and its entries, in a fixed order; entry // BANDS is the content."""
        for k in np.flatnonzero(np.diff(self.cuts)).tolist():
            yield k, self.order[self.cuts[k]:self.cuts[k + 1]]


def collisions(packets: list[bytes]) -> list[bytes]:
    """For each packet of a shard: which entries have a key that two contents
    share, the number of contents of those keys, and the highest 32 bits of a
    content that is a pivot of the key."""
    prints, contents = [], []
    for packet in packets:
        diffs, content = _unpacked(packet, np.uint32, np.uint32)
        prints.append(np.cumsum(diffs, dtype=np.uint32))
        contents.append(content)
    sizes = [len(p) for p in prints]
    pair = np.concatenate(prints).astype(np.uint64) << np.uint64(32) | np.concatenate(contents).astype(np.uint64)
    distinct = np.unique(pair)
    key = distinct >> np.uint64(32)
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(head, len(key)))
    pivot = (distinct[np.minimum(head + PIVOTS - 1, head + count - 1)] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    group = np.searchsorted(key[head], pair >> np.uint64(32))
    out = []
    for own in np.split(group, np.cumsum(sizes)[:-1]):
        shared = count[own] > 1
        out.append(_packed(np.packbits(shared), count[own][shared].astype(np.uint32), pivot[own][shared]))
    return out


# --- judging the paragraphs of a key ------------------------------------------------

def jaccard(first: np.ndarray, shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact similarity of pairs of sorted distinct runs of shingles."""
    na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
    both = np.zeros(len(a), np.int64)
    for i in range(0, len(a), 1 << 14):
        part = slice(i, i + (1 << 14))
        n = np.stack([na[part], nb[part]], 1).ravel()
        start = np.stack([first[a[part]], first[b[part]]], 1).ravel()
        pair = np.repeat(np.repeat(np.arange(len(na[part])), 2), n)
        value = shingles[np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)]
        order = np.lexsort((value, pair))
        pair, value = pair[order], value[order]
        both[part] = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (value[1:] == value[:-1])], minlength=len(na[part]))
    return both / np.maximum(na + nb - both, 1)


def judge(rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (contents a, b) among rows sorted by (key, chunk); rows with a
    ``label`` are linked only across labels, one side not of the main one."""
    content = np.asarray(rows.column("content"))
    shingle_rows = rows.column("shingles").combine_chunks()
    raw, offsets = K.utf8(shingle_rows)
    shingles, first = raw[: offsets[-1]].view(np.uint64), offsets // 8
    raw, offsets = K.utf8(rows.column("bands").combine_chunks())
    bands = raw[: offsets[-1]].view(np.uint32).reshape(-1, BANDS)
    band = np.asarray(rows.column("band"))
    key, chunk = np.asarray(rows.column("key")), np.asarray(rows.column("chunk"))
    main, label = np.asarray(rows.column("main")), np.asarray(rows.column("label"))
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])])
    head = np.flatnonzero(new)
    sizes = np.diff(np.append(head, len(key)))
    links = []

    def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        fresh = content[a] != content[b]
        # judged in the first band that the pair shares
        shared = bands[a] == bands[b]
        fresh &= shared.argmax(1) == band[a]
        out = np.zeros(len(a), bool)
        at = np.flatnonzero(fresh)
        out[at] = jaccard(first, shingles, a[at], b[at]) >= THRESHOLD - 1e-12
        return out

    small = np.flatnonzero((sizes > 1) & (sizes <= 16))
    for size in np.unique(sizes[small]).tolist():
        i, j = np.triu_indices(size, 1)
        start = head[small[sizes[small] == size]]
        for k in range(0, len(start), max(1, (1 << 17) // len(i))):
            some = start[k: k + max(1, (1 << 17) // len(i))]
            a, b = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
            apart = (label[a] != label[b]) | (label[a] == 0)
            a, b = a[apart], b[apart]
            hit = linked(a, b)
            links.append((content[a[hit]], content[b[hit]]))
    for k in np.flatnonzero(sizes > 16).tolist():
        links += _judge_large(np.arange(head[k], head[k] + sizes[k]), content, label, main, linked)
    return links


def _judge_large(own, content, label, main, linked):
    """One member against the rest, then of those still apart from it each
    against all members of other components; exact copies count as one."""
    own = own[np.unique(content[own], return_index=True)[1]]
    group, out = np.arange(len(own)), []
    if (label[own] != 0).any():  # members that earlier rounds connected
        group = np.unique(label[own], return_inverse=True)[1].astype(np.int64)
    todo = np.flatnonzero(~main[own]).tolist()  # pairs within the main component are settled
    while todo:
        pivot = todo.pop(0)
        rest = np.flatnonzero(group != group[pivot])
        if not len(rest):
            break
        hit = rest[linked(np.minimum(own[pivot], own[rest]), np.maximum(own[pivot], own[rest]))]
        if len(hit):
            out.append((np.full(len(hit), content[own[pivot]]), content[own[hit]]))
            group[np.isin(group, group[hit])] = group[pivot]
        todo = [t for t in todo if group[t] != group[pivot]] if len(hit) > len(rest) // 2 else todo
        if len(hit) > len(rest) // 2:
            largest = group[pivot]
            todo = [t for t in np.flatnonzero(group != largest).tolist() if t in set(todo)]
    return out


_ROWS = "key long, chunk long, band int, content long, label long, main boolean, bands binary, shingles binary"


def _links(rows: DataFrame) -> DataFrame:
    """(a, b) contents linked within (key, chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                held.append(batch.slice(a, 4096))
                count += held[-1].num_rows
                if count >= 8192:  # whole groups only: the last one may go on
                    table = pa.Table.from_batches(held)
                    key, chunk = np.asarray(table.column("key")), np.asarray(table.column("chunk"))
                    other = np.flatnonzero((key != key[-1]) | (chunk != chunk[-1]))
                    if len(other):
                        yield from send(table.slice(0, int(other[-1]) + 1))
                        table = table.slice(int(other[-1]) + 1)
                    held, count = table.to_batches(), table.num_rows
        if count:
            yield from send(pa.Table.from_batches(held))

    def send(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for a, b in judge(table):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    n = K.partitions(rows.sparkSession)
    return rows.repartition(n, "key", "chunk").sortWithinPartitions("key", "chunk", "content").mapInArrow(K.tidy(run), "a long, b long").distinct()


# --- the job ---------------------------------------------------------------------------

def _stored_blocks(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in K.text_chunks(batch, "text", BLOCK_BYTES):
                data, offsets = K.utf8(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{task}-{n}"]), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([K.pack(offsets)], pa.binary()),
                     pa.array([zstandard.ZstdCompressor(3).compress(data[: offsets[-1]].tobytes())], pa.binary()), pa.array([int(offsets[-1])], pa.int64())],
                    ["block", "doc_ids", "offsets", "data", "n_bytes"])
                n += 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return K.bucketed(rows.mapInArrow(K.tidy(run), "block string, doc_ids array<long>, offsets binary, data binary, n_bytes long"), "paragraph-blocks", "block")


def dedup_paragraphs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_paragraphs (compared), n_removed,
    classes (for each removed paragraph the smallest document of its class,
    distinct, ascending) and text (the lines that stay)."""
    blocks = _stored_blocks(docs, text_col, id_col)
    n_shards = max(1, -(-(blocks.agg(F.sum("n_bytes")).first()[0] or 0) * BANDS // 120 // SHARD_KEYS))
    blocks = blocks.drop("n_bytes")

    def rows_of(batches: Iterator[pa.RecordBatch], n_shards: int = n_shards) -> Iterator[tuple[dict, Block]]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield row, Block(row, n_shards)

    def send_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in rows_of(batches):
            for shard, entry in block.entries():
                packet = _packed(np.diff((block.entry_key[entry] & np.uint64(0xFFFFFFFF)).astype(np.uint32), prepend=np.uint32(0)),
                                 (block.contents[entry // BANDS] >> np.uint64(32)).astype(np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([row["block"]]), pa.array([packet], pa.binary())], ["shard", "block", "packet"])

    def scan_keys(key, group: pd.DataFrame) -> pd.DataFrame:
        K.release()
        return group.assign(found=collisions(group["packet"].tolist()))[["block", "shard", "found"]]

    def send_paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in rows_of(batches):
            yield from _colliding(block, row["found"] or ())

    def send_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in rows_of(batches, 0):
            again = np.bincount(np.searchsorted(block.contents, block.p.content[block.takes_part]), minlength=len(block.contents))
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(block.contents), pa.string()), pa.array(block.contents.view(np.int64)), pa.array(block.low), pa.array(again)],
                                             ["block", "content", "low", "n"])

    keys = blocks.mapInArrow(K.tidy(send_keys), "shard long, block string, packet binary")
    found = keys.groupBy("shard").applyInPandas(scan_keys, "block string, shard long, found binary").groupBy("block").agg(F.collect_list(F.struct("shard", "found")).alias("found"))
    rows = K.written(blocks.join(found, "block").mapInArrow(K.tidy(send_paragraphs), _ROWS + ", many boolean"), "colliding")
    edges = K.written(_links(rows), "paragraph-links")
    roots = components(edges)
    # members of keys that were dealt out in chunks, by component
    split = rows.where("many").dropDuplicates(["key", "content"]).join(roots.withColumnRenamed("node", "content"), "content", "left").withColumn("label", F.coalesce("root", "content")).drop("root")
    by_key = split.groupBy("key", "label").count()
    chief = by_key.groupBy("key").agg(F.max_by("label", "count").alias("chief"), F.sum("count").alias("all"), F.count("*").alias("parts"), F.max("count").alias("most")).where("parts > 1")
    open_ = K.written(split.join(chief, "key").withColumn("main", F.col("label") == F.col("chief")), "apart")
    if not open_.isEmpty():
        # each member outside of the chief component with all members, chunk by chunk
        of = F.pmod(F.xxhash64("content", "key"), F.ceil(F.col("all") / CHUNK))
        low = open_.where("NOT main").withColumn("side", F.pmod(F.xxhash64("content", "key"), F.ceil((F.col("all") - F.col("most")) / CHUNK)))
        sides = F.ceil((F.col("all") - F.col("most")) / CHUNK)
        left = low.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("all") / CHUNK) - 1))).withColumn("chunk", F.col("side") * 1000003 + F.col("cell"))
        right = open_.withColumn("cell", of).withColumn("side", F.explode(F.sequence(F.lit(0).cast("long"), sides - 1))).withColumn("chunk", F.col("side") * 1000003 + F.col("cell"))
        names = [f.split(" ")[0] for f in _ROWS.split(", ")]
        edges = K.written(edges.unionByName(_links(left.select(*names).unionByName(right.select(*names)).dropDuplicates(["key", "chunk", "content"]))), "paragraph-links")
        roots = components(edges)
    contents = K.written(blocks.mapInArrow(K.tidy(send_contents), "block string, content long, low long, n long"), "contents")
    named = contents.join(roots, contents.content == roots.node, "left").select("block", "content", "low", "n", F.coalesce("root", "content").alias("class"))
    classes = named.groupBy("class").agg(F.min("low").alias("keeper"), F.sum("n").alias("members")).where("members > 1").select(F.col("class").alias("of_class"), "keeper")
    answers = named.join(classes, F.col("class") == F.col("of_class")).groupBy("block").agg(F.collect_list(F.struct("content", "class", "keeper")).alias("answers"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                yield _cut(Block(one.select(["doc_ids", "offsets", "data"]).to_pylist()[0]), one.column("answers"))

    return blocks.join(answers, "block", "left").select("doc_ids", "offsets", "data", "answers").mapInArrow(
        K.tidy(cut), "doc_id long, n_paragraphs long, n_removed long, classes array<long>, text string")


def _colliding(block: Block, found: list[dict]) -> Iterator[pa.RecordBatch]:
    """Rows for the keys that contents of this block share with others."""
    answer = {f["shard"]: f["found"] for f in found}
    for shard, entry in block.entries():
        if shard not in answer:
            continue
        bits, count, pivot = _unpacked(answer[shard], np.uint8, np.uint32, np.uint32)
        entry = entry[np.unpackbits(bits, count=len(entry)).astype(bool)]
        content = block.contents[entry // BANDS]
        chunks = -(-count.astype(np.int64) // CHUNK)
        is_pivot = ((content >> np.uint64(32)).astype(np.uint32) <= pivot) & (chunks > 1)
        times = np.where(is_pivot, chunks, 1)
        chunk = np.where(np.repeat(is_pivot, times), np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times),
                         np.repeat((content % np.uint64(1 << 31)).astype(np.int64) % chunks, times))
        entry, many = np.repeat(entry, times), np.repeat(chunks > 1, times)
        for a in range(0, len(entry), 4096):
            some = entry[a:a + 4096]
            own = block.own[some // BANDS]
            n = block.p.first[own + 1] - block.p.first[own]
            flat = block.p.shingles[np.arange(int(n.sum())) + np.repeat(block.p.first[own] - (np.cumsum(n) - n), n)]
            shingles = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(n) * 8]).astype(np.int32)), pa.py_buffer(flat)])
            bands = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((np.arange(len(own) + 1) * 4 * BANDS).astype(np.int32)), pa.py_buffer(np.ascontiguousarray((block.p.bands[own] >> np.uint64(32)).astype(np.uint32)))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.p.bands[own, some % BANDS].view(np.int64)), pa.array(chunk[a:a + 4096]), pa.array((some % BANDS).astype(np.int32)), pa.array(block.contents[some // BANDS].view(np.int64)),
                 pa.array(np.zeros(len(own), np.int64)), pa.array(np.zeros(len(own), bool)), bands, shingles, pa.array(many[a:a + 4096])],
                [f.split(" ")[0] for f in _ROWS.split(", ")] + ["many"])


def _without(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    """The text without these paragraphs (ascending); a line of which nothing
    stays goes with its line break."""
    kept, at, k = [], 0, 0
    for line in text.split(b"\n"):
        stop, here, parts = at + len(line), at, []
        while k < len(starts) and starts[k] < stop:
            parts.append(text[here:starts[k]])
            here, k = ends[k], k + 1
        rest = b"".join([*parts, text[here:stop]])
        if rest or not parts:
            kept.append(rest)
        at = stop + 1
    return b"\n".join(kept)


def _cut(block: Block, answers: pa.Array) -> pa.RecordBatch:
    flat = answers.flatten()
    content, group, keeper = (np.asarray(flat.field(f)) for f in ("content", "class", "keeper")) if len(flat) else (np.zeros(0, np.int64),) * 3
    order = np.argsort(content)
    content, group, keeper = content[order], group[order], keeper[order]
    p, n = block.p, len(block.ids)
    own = p.content.view(np.int64)
    at = np.minimum(np.searchsorted(content, own), max(len(content) - 1, 0))
    known = block.takes_part & (content[at] == own) if len(content) else np.zeros(len(own), bool)
    removed, keep_of = np.zeros(len(own), bool), np.zeros(len(own), np.int64)
    keep_of[known] = keeper[at[known]]
    removed[known] = keep_of[known] != block.doc[p.text[known]]
    # in the keeper itself the first paragraph of the class stays
    mine = np.flatnonzero(known & ~removed)
    pair = np.stack([p.text[mine], group[at[mine]]], 1) if len(mine) else np.zeros((0, 2), np.int64)
    _, first = np.unique(pair, axis=0, return_index=True)
    later = np.ones(len(mine), bool)
    later[first] = False
    removed[mine[later]] = True
    raw, bounds = block.data.tobytes(), block.offsets.tolist()
    gone = np.flatnonzero(removed)
    by_text = np.searchsorted(p.text[gone], np.arange(n + 1))
    texts, classes = [], []
    for i in range(n):
        mine = gone[by_text[i]:by_text[i + 1]]
        text = raw[bounds[i]:bounds[i + 1]]
        if len(mine):
            text = _without(text, (p.start[mine] - bounds[i]).tolist(), (p.end[mine] - bounds[i]).tolist())
        texts.append(text)
        classes.append(np.unique(keep_of[mine]).tolist())
    return pa.RecordBatch.from_arrays(
        [pa.array(block.ids, pa.int64()), pa.array(np.bincount(p.text, minlength=n)), pa.array(np.diff(by_text)), pa.array(classes, pa.list_(pa.int64())), pa.array(texts, pa.binary()).cast(pa.string(), safe=False)],
        ["doc_id", "n_paragraphs", "n_removed", "classes", "text"])
