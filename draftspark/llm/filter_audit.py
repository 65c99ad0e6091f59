"""Interaction of quality filters, audited over every order of applying them.

One finite-state pass over the bytes of a batch drives the counts: ``STEP`` maps
(state, byte class) to what the byte emits, the state being whether the byte
before was inside a word.  Emissions are word starts, word ends, capitals, code
points and symbols.  The word spans go into an open-addressing hash table as
they come; a slot that has the hash of a span is verified byte by byte before it
counts as the same word, and spans of another word probe on, so the distinct
words are exact.

Each document then is five bits (which filters it fails).  Spark counts documents
by part, bits and labels, combined before the shuffle, and every figure of every
order follows from these counts alone: a filter removes the documents that fail
it and none before it.

The filters: A under ``MIN_WORDS`` words; B distinct words under 65 per cent of
the words; C capitals over 5 per cent of the code points; D any symbol; E a text
that a smaller id has too.

Defined results: null texts count as empty (and equal empty ones); a null id is
smaller than none, so its row never fails E nor makes another fail it; rows
repeated with the same id don't fail E through each other; a null source is the
part ''; rows without labels, null ids among them, count in neither loss; several labels of an id
count if any is 1.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

#: Thresholds and symbols of the filters.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MOST_CAPITALS = 50, 65, 5
SYMBOLS = b"#$%&*|"

# byte classes, and what a byte emits by (state, class)
_WHITE, _CAPITAL, _SYMBOL, _TAIL, _OTHER = range(5)
CLASS = np.full(256, _OTHER, np.uint8)
CLASS[list(K.WHITE)] = _WHITE
CLASS[65:91] = _CAPITAL
CLASS[list(SYMBOLS)] = _SYMBOL
CLASS[0x80:0xC0] = _TAIL
WORD_START, WORD_END, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8, 16
OUTSIDE, INSIDE = 0, 1
STEP = np.zeros((2, 5), np.uint8)
for _state in (OUTSIDE, INSIDE):
    for _class in range(5):
        _word = _class != _WHITE
        STEP[_state, _class] = ((WORD_START if _word and _state == OUTSIDE else 0) | (WORD_END if not _word and _state == INSIDE else 0)
                                | (CAPITAL if _class == _CAPITAL else 0) | (POINT if _class != _TAIL else 0) | (SYMBOL if _class == _SYMBOL else 0))


def transduce(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What every byte emits; each text starts outside of a word."""
    kind = CLASS[data[: int(offsets[-1])]]
    state = np.zeros(len(kind), np.uint8)
    state[1:] = kind[:-1] != _WHITE
    edge = offsets[:-1]
    state[edge[edge < len(kind)]] = OUTSIDE
    return STEP.ravel()[state * np.uint8(5) + kind]


def distinct_words(data: np.ndarray, start: np.ndarray, size: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """Distinct words of each text, by inserting all spans into one table whose
    key is (text, bytes of the span)."""
    hashes = K.hash_spans(data, start, size) ^ K.mix(text.astype(np.uint64) + np.uint64(1))
    bits = max(8, int(2 * len(start)).bit_length())
    table = np.full(1 << bits, -1, np.int32)
    slot = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    lanes = np.ndarray((max(len(data) - 7, 0),), "<u8", data, 0, (1,))
    todo = np.arange(len(start), dtype=np.int32)
    new = np.zeros(n_texts, np.int64)
    while len(todo):
        at = slot[todo]
        free = table[at] < 0
        table[at[free][::-1]] = todo[free][::-1]  # the first of those that want a slot gets it
        owner = table[at]
        new += np.bincount(text[todo[owner == todo]], minlength=n_texts)
        same = (hashes[owner] == hashes[todo]) & (size[owner] == size[todo]) & (text[owner] == text[todo])
        same[same] = verified(lanes, start[owner[same]], start[todo[same]], size[todo[same]])
        todo = todo[~same]
        slot[todo] = (slot[todo] + 1) & ((1 << bits) - 1)
    return new


def verified(lanes: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether pairs of spans of equal size hold the same bytes."""
    equal, rows = np.ones(len(a), bool), np.arange(len(a))
    done = 0
    while len(rows):
        left = size[rows] - done
        differ = lanes[a[rows] + done] ^ lanes[b[rows] + done]
        short = left < 8
        differ[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        equal[rows[differ != 0]] = False
        rows = rows[(differ == 0) & (left > 8)]
        done += 8
    return equal


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """row (the other columns), n_words, n_distinct, n_capitals, n_chars, n_symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.text_chunks(batch, "text", 1 << 20):  # small enough that the table stays in the cache
                data, offsets = K.utf8(part.column("text"))
                n = len(offsets) - 1
                out = transduce(data, offsets)

                def per_text(bit, out=out, offsets=offsets):
                    total = np.concatenate([[0], np.cumsum((out & bit) != 0)])
                    return np.diff(total[offsets])

                start = np.flatnonzero(out & WORD_START)
                first = np.searchsorted(start, offsets)
                # a word ends where the transducer says so, or with its text
                end = np.flatnonzero(out & WORD_END)
                text = np.repeat(np.arange(n), np.diff(first))
                follow = np.searchsorted(end, start)
                end = np.minimum(np.append(end, offsets[-1])[follow], offsets[1:][text])
                words = np.diff(first)
                distinct = distinct_words(data, start, end - start, text, n)
                yield pa.RecordBatch.from_arrays([part.column("row"), *map(pa.array, (words, distinct, per_text(CAPITAL), per_text(POINT), per_text(SYMBOL)))],
                                                 ["row", "n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols"])

    rows = docs.select(K.others(docs, text_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(K.tidy(run), K.schema(rows.select("row"), "n_words long, n_distinct long, n_capitals long, n_chars long, n_symbols long"))


def failures(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "source") -> DataFrame:
    """(part, fails, good, toxic, n): documents by the filters they fail (bit i
    for the i-th filter) and their labels; a few dozen rows a part."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                      F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("mark"), F.col(text_col).alias("text"))
    w, d, c, p, s = (F.col(x) for x in ("n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols"))
    alone = [w < MIN_WORDS, 100 * d < MIN_DISTINCT * w, 100 * c > MOST_CAPITALS * p, s > 0]
    fails = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(alone)), F.lit(0)).cast("int")
    known = labels.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    seen = text_counts(own, "text").select("row.*", fails.alias("fails"))
    rows = (seen.join(known, F.col("id") == F.col("label_id"), "left").select("mark", "id", "part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
            .groupBy("mark", "id", "part", "fails", "good", "toxic").agg(F.count("*").alias("n")))
    # by text: few rows, however many copies; those of its smallest id don't fail E
    kinds = rows.groupBy("mark", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"), F.min("id").alias("low"), F.min_by("n", "id").alias("n_low"))
    kinds = K.written(kinds, "audit-kinds")
    low = kinds.groupBy("mark").agg(F.min("low").alias("low_all"))
    kinds = kinds.join(low, "mark").withColumn("keep", F.col("n_null") + F.when(F.col("low") == F.col("low_all"), F.col("n_low")).otherwise(0))
    last = 1 << len(alone)
    split = F.array(F.struct(F.col("fails"), F.col("keep").alias("n")), F.struct((F.col("fails") + last).alias("fails"), (F.col("n") - F.col("keep")).alias("n")))
    return (kinds.select("part", "good", "toxic", F.inline(split)).where("n > 0")
            .groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n")))


def audit(counts: DataFrame) -> DataFrame:
    """All figures of all orders from the counts of ``failures``: one row per
    part, order and step."""
    n = len(FILTERS)
    per_part = counts.groupBy("part").agg(F.collect_list(F.struct("fails", "good", "toxic", "n")).alias("kinds"))
    steps = []
    for order in permutations(range(n)):
        before = 0
        for k, i in enumerate(order):
            steps.append(("".join(FILTERS[j] for j in order), k + 1, 1 << i, before))
            before |= 1 << i
    table = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(b).alias("bit"), F.lit(e).alias("before")) for o, k, b, e in steps])
    rows = per_part.select("part", "kinds", F.inline(table))

    def total(cond, value=None):
        return F.aggregate("kinds", F.lit(0).cast("long"), lambda acc, x: acc + F.when(cond(x), value(x) if value else x["n"]).otherwise(F.lit(0).cast("long")))

    def fails(x):
        return x["fails"].bitwiseAND(F.col("bit")) != 0

    def gone(x):
        return x["fails"].bitwiseAND(F.col("before")) != 0

    def here(x):
        return fails(x) & ~gone(x)

    # of the orders, those in which the filter comes first of all that the document fails
    share = F.create_map(*[F.lit(v) for k in range(1, n + 1) for v in (k, len(steps) // n // k)])
    return rows.select(
        "part", "filter_order", "step",
        total(lambda x: ~fails(x) & ~gone(x)).alias("kept"), total(here).alias("removed"), total(lambda x: fails(x) & gone(x)).alias("redundant"),
        total(lambda x: x["fails"] == F.col("bit")).alias("unique_fails"), total(lambda x: here(x) & x["good"]).alias("good_lost"),
        total(lambda x: here(x) & x["toxic"]).alias("toxic_lost"),
        total(fails, lambda x: x["n"] * share[F.bit_count(x["fails"])]).alias("shapley"))
