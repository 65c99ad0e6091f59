"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores the postings of all training tokens, sharded by
documents: a row holds the documents of one shard, its sorted term dictionary
(64-bit term hashes) and, for each term, the ascending list of its token
positions in the shard.  A search sends the test phrases to every shard in
blocks of a bounded size; a shard looks up the phrase's terms, starts from the
rarest list, and intersects it with the other lists, each adjusted by the
term's offset in the phrase (exact phrases) or opened by a slop (proximity).
No postings are shuffled.

Words are maximal runs of ``[0-9a-z]`` and non-ASCII characters after A-Z are
lower-cased.  Defined results: null or empty texts have no words; an item of
fewer words than a window is one window, an item of none has no window; rows
that share a ``doc_id`` stay separate rows; items that share an ``item_id``
count once; a null ``item_id`` counts as the item named by the empty string.
Empty tables give no hits or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

WINDOW = 10              # words of a test window
BLOCK_WINDOWS = 40_000   # test windows sent to the shards at once, on average
PASS_BLOCKS = 4          # blocks of a pass over the index
SHARD_BYTES = 2 << 20    # text of one shard (one document at least)

_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term hash of every word, first word of each text and the total)."""
    low = K.lower_ascii(data)
    starts, ends, first = K.spans_of(_IS_WORD[low], offsets)
    return K.hash_spans(low, starts, ends - starts), first


_INDEX = ("shard string, doc_ids array<long>, text_marks array<long>, first binary, "
          "terms binary, lists binary, postings binary")


def build_index(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The stored index (Parquet in the shared checkpoint folder)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in K.text_chunks(batch, "text", SHARD_BYTES):
                term, first = words(*K.utf8(part.column("text")))
                order = np.argsort(term, kind="stable").astype(np.int32)
                term = term[order]
                head = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_pylist([{
                    "shard": f"{task}-{n}", "doc_ids": part.column("doc_id").to_pylist(), "text_marks": part.column("mark").to_pylist(),
                    "first": K.pack(first.astype(np.int32)), "terms": K.pack(term[head]),
                    "lists": K.pack(np.append(head, len(term)).astype(np.int32)), "postings": K.pack(order)}], schema)
                n += 1

    schema = pa.schema([("shard", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("text_marks", pa.list_(pa.int64())),
                        ("first", pa.binary()), ("terms", pa.binary()), ("lists", pa.binary()), ("postings", pa.binary())])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(text_col)).alias("mark"))
    return K.written(rows.mapInArrow(K.tidy(run), _INDEX), "postings")


class Shard:
    """One row of the index, its lists ready to intersect."""

    def __init__(self, row: dict):
        self.first = np.frombuffer(row["first"], np.int32)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.lists = np.frombuffer(row["lists"], np.int32)
        self.postings = np.frombuffer(row["postings"], np.int32)

    def look_up(self, wanted: np.ndarray) -> np.ndarray:
        """Number of each term in the dictionary, or -1."""
        if not len(self.terms):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        return np.where(self.terms[at] == wanted, at, -1)

    def positions(self, term: int) -> np.ndarray:
        return self.postings[self.lists[term]: self.lists[term + 1]]

    def rarest_first(self, phrase: np.ndarray) -> list[int]:
        """Offsets in the phrase, those of the shortest lists first."""
        return np.argsort(self.lists[phrase + 1] - self.lists[phrase], kind="stable").tolist()

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1

    def phrase(self, phrase: np.ndarray) -> np.ndarray:
        """Start positions of the exact phrase (term numbers), within documents."""
        order = self.rarest_first(phrase)
        starts = self.positions(phrase[order[0]]) - order[0]
        for offset in order[1:]:
            if not len(starts):
                return starts
            starts = starts[_member(self.positions(phrase[offset]), starts + offset)]
        starts = starts[starts >= 0]
        return starts[self.doc_of(starts) == self.doc_of(starts + (len(phrase) - 1))] if len(starts) else starts

    def near(self, phrase: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest term that have every other term of the
        phrase within ``slop`` words, in any order, in the same document."""
        order = self.rarest_first(phrase)
        at = self.positions(phrase[order[0]])
        doc = self.doc_of(at)
        low, high = np.maximum(at - slop, self.first[doc]), np.minimum(at + slop, self.first[doc + 1] - 1)
        for offset in order[1:]:
            found = self.positions(phrase[offset])
            keep = np.searchsorted(found, high, "right") > np.searchsorted(found, low, "left")
            at, low, high = at[keep], low[keep], high[keep]
        return at


def _member(ascending: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    return ascending[at] == values


def test_windows(items: DataFrame, text_col: str = "text", id_col: str = "item_id", size: int = WINDOW) -> DataFrame:
    """(item_id string, window binary): the term hashes of each item's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.text_chunks(batch, "text"):
                term, first = words(*K.utf8(part.column("text")))
                ids, windows = [], []
                for item, a, b in zip(part.column("item_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    own = {K.pack(term[i:i + size]) for i in range(a, max(a + 1, b - size + 1))} if b > a else ()
                    ids += [item or ""] * len(own)
                    windows += own if size < b - a else [K.pack(term[a:b])] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(windows, pa.binary())], ["item_id", "window"])

    return items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(
        K.tidy(run), "item_id string, window binary")


def _block(windows: DataFrame, number: int, n_blocks: int) -> list[tuple[int, np.ndarray]]:
    """One block of the distinct test windows, dealt by hash: of a bounded size."""
    rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == number).select("window_id", "window").collect()
    return [(r["window_id"], np.frombuffer(r["window"], np.uint64)) for r in rows]


def search(index: DataFrame, windows: DataFrame, slop: int | None = None) -> DataFrame:
    """Documents of the index with what the windows (window_id, window) hit in
    them: shard, doc_no, doc_id, text_mark, n_words, n_hit (words inside an
    occurrence; for proximity, rarest terms with all others near), window_ids.

    ``PASS_BLOCKS`` blocks of windows follow one another as steps of one pass
    over the index; the words hit so far travel along as a bitmap.  What a pass
    marks is written and its blocks are released before the next one, so neither
    driver memory nor the plan grows with the windows.  The bitmaps of a shard are
    joined at the end: words that windows of several blocks hit count once."""
    spark = index.sparkSession
    marks = "shard string, hit binary, hit_docs array<int>, hit_windows array<long>"
    marked = marks + ", first binary, terms binary, lists binary, postings binary"
    unmarked = index.withColumns({"hit": F.lit(None).cast("binary"), "hit_docs": F.array().cast("array<int>"), "hit_windows": F.array().cast("array<long>")})

    def step(block, last):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block_windows = block.value
            lengths = np.array([len(w) for _, w in block_windows], np.int64)
            wanted, which = np.unique(np.concatenate([w for _, w in block_windows]) if block_windows else np.zeros(0, np.uint64), return_inverse=True)
            first_of = np.cumsum(lengths) - lengths
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    shard = Shard(row)
                    n = int(shard.first[-1])
                    hit = np.unpackbits(np.frombuffer(row["hit"], np.uint8), count=n).astype(bool) if row["hit"] else np.zeros(n, bool)
                    pairs = set()
                    if len(wanted):
                        terms = shard.look_up(wanted)[which]
                        for k in np.flatnonzero(np.minimum.reduceat(terms, first_of) >= 0).tolist():
                            phrase = terms[first_of[k]: first_of[k] + lengths[k]]
                            starts = shard.phrase(phrase) if slop is None else shard.near(phrase, slop)
                            if len(starts):
                                hit[(starts[:, None] + np.arange(lengths[k] if slop is None else 1)).ravel()] = True
                                pairs |= {(d, block_windows[k][0]) for d in np.unique(shard.doc_of(starts)).tolist()}
                    pairs = sorted(pairs)
                    row |= {"hit": K.pack(np.packbits(hit)), "hit_docs": row["hit_docs"] + [d for d, _ in pairs], "hit_windows": row["hit_windows"] + [w for _, w in pairs]}
                    kept = [f for f in batch.schema if not last or f.name not in ("first", "terms", "lists", "postings")]
                    yield pa.RecordBatch.from_pylist([{f.name: row[f.name] for f in kept}], pa.schema(kept))
        return run

    n_blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    found = None
    for start in range(0, n_blocks, PASS_BLOCKS):
        df, sent, numbers = unmarked, [], range(start, min(start + PASS_BLOCKS, n_blocks))
        for number in numbers:
            sent.append(spark.sparkContext.broadcast(_block(windows, number, n_blocks)))
            last = number == numbers[-1]  # nothing of this pass reads the lists any more
            df = df.select(*[f.split(" ")[0] for f in marked.split(", ")]).mapInArrow(K.tidy(step(sent[-1], last)), marks if last else marked)
        df = K.written(df, "marks")
        for block in sent:
            block.destroy()
        found = df if found is None else found.unionByName(df)
    found = found.groupBy("shard").agg(F.collect_list(F.struct("hit", "hit_docs", "hit_windows")).alias("marks"))
    df = index.select("shard", "doc_ids", "text_marks", "first").join(found, "shard")

    def per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first = np.frombuffer(row["first"], np.int32).astype(np.int64)
                bits = np.bitwise_or.reduce([np.frombuffer(m["hit"], np.uint8) for m in row["marks"]])
                hits = np.concatenate([[0], np.cumsum(np.unpackbits(bits, count=int(first[-1])))]).astype(np.int64)
                docs, own = len(row["doc_ids"]), {}
                for m in row["marks"]:
                    for d, w in zip(m["hit_docs"], m["hit_windows"], strict=True):
                        own.setdefault(d, []).append(w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * docs), pa.array(range(docs), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["text_marks"], pa.int64()),
                     pa.array(np.diff(first)), pa.array(np.diff(hits[first])), pa.array([own.get(d, []) for d in range(docs)], pa.list_(pa.int64()))],
                    ["shard", "doc_no", "doc_id", "text_mark", "n_words", "n_hit", "window_ids"])

    return df.mapInArrow(
        K.tidy(per_document), "shard string, doc_no int, doc_id long, text_mark long, n_words long, n_hit long, window_ids array<long>")


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                  item_text_col: str = "text", item_id_col: str = "item_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_mark (xxhash64 of the text),
    n_words, n_hit, item_ids (sorted strings of the items with a window in it)."""
    members = K.written(test_windows(items, item_text_col, item_id_col).withColumn("window_id", F.xxhash64("window")), "windows")
    found = K.written(search(build_index(docs, text_col, id_col), members.select("window_id", "window").distinct()), "hits")
    named = (found.where("n_hit > 0").select("shard", "doc_no", F.explode("window_ids").alias("window_id"))
             .join(members.select("window_id", "item_id"), "window_id")
             .groupBy("shard", "doc_no").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")))
    return found.join(named, ["shard", "doc_no"], "left").select(
        "doc_id", "text_mark", "n_words", "n_hit", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that contain a window of a test item.  These are
    written first, so that their size is known and the texts stay where they are
    unless that is too much to broadcast."""
    bad = K.written(contamination(docs, items, text_col, id_col).where("n_hit > 0")
                    .select(F.col("doc_id").alias("_bad_id"), F.col("text_mark").alias("_bad_mark")).distinct(), "contaminated")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_bad_id")) & (F.xxhash64(F.col(text_col)) == F.col("_bad_mark"))
    return docs.join(bad, same, "left_anti")
