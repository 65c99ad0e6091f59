"""Language identification with bit-sliced Bloom filters of character n-grams.

Training counts the n-grams of each language over all training rows and keeps,
for each language, those that are frequent enough in it (``MIN_SHARE`` of its
n-grams, which bounds a filter's size whatever the corpus) and not much rarer
than in the language where they are most frequent (``MARGIN``).  The kept
n-grams of all languages go into one table of slots; a slot holds a bitmask of
languages, so that ANDing an n-gram's few slots returns every language that
contains it.  A text is judged by its popcounts: for each language the number
of its n-grams that the filter claims, corrected for the false positives that
the fill of that language's bit slice predicts.

N-grams run within words and may include one boundary mark on either side.
Defined results: null texts and texts without a letter get ``und`` and score 0;
if no training row has a language and a letter, every text gets ``und``.  Ties
go to the alphabetically first language.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

ORDERS = (2, 3, 4)       # characters of an n-gram, boundary marks included
MIN_SHARE = 1e-5         # an n-gram is kept at this share of a language's n-grams of its order
MARGIN = 0.5             # ... and at this share of its rate in the language where it is most frequent
SLOTS_PER_KEY, HASHES = 16, 2


@functools.cache
def _folding() -> np.ndarray:
    """For every code point its lower case if it is a letter, else 0."""
    fold = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            fold[c] = ord(low) if len(low) == 1 else c
    return fold


class Words:
    """The words (runs of letters, lower-cased) of a column of texts, each
    distinct one once, and the n-grams of the distinct words.  ``apart`` parts
    equal words of texts that differ in it."""

    def __init__(self, column: pa.Array, apart: np.ndarray | None = None):
        data, offsets = K.utf8(column)
        self.n_texts = len(offsets) - 1
        raw = data[: offsets[-1]].tobytes()
        codes = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        chars = np.concatenate([[0], np.cumsum((data[: offsets[-1]] & 0xC0) != 0x80, dtype=np.int32)])[offsets].astype(np.int64)
        if chars[-1] != len(codes):  # malformed bytes were replaced: decode text by text
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
            chars = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        letters = np.concatenate([_folding()[codes], np.zeros(4, np.uint32)])
        start, end, first = K.spans_of(letters[:-4] != 0, chars)
        del data, raw, codes
        self.text = np.repeat(np.arange(self.n_texts), np.diff(first))
        self.letters = np.concatenate([[0], np.cumsum(end - start)])[first[1:]] - np.concatenate([[0], np.cumsum(end - start)])[first[:-1]]
        name = K.hash_spans(letters.view(np.uint8), start * 4, (end - start) * 4)
        if apart is not None:
            name = name ^ K.mix(apart[self.text].astype(np.uint64) + np.uint64(1))
        _, self.own, self.which = np.unique(name, return_index=True, return_inverse=True)
        # the distinct words in a line, a boundary mark (0) before each and after the last
        size = (end - start)[self.own]
        to = np.cumsum(size + 1)
        line, self.word = np.zeros(int(to[-1]) + 1 if len(to) else 1, np.uint64), np.repeat(np.arange(len(size)), size + 1)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        line[at + np.repeat(to - size, size)] = letters[at + np.repeat(start[self.own], size)]
        self._grams(line)

    def _grams(self, line: np.ndarray) -> None:
        """gram (hash), order and of (word) of every n-gram; marks only at its ends."""
        some, grams, orders, of = line != 0, [], [], []
        word = np.append(self.word, len(self.own) - 1)  # a mark counts with the word after it
        for order in ORDERS:
            m = len(line) - order + 1
            if m <= 0:
                continue
            h, inner = np.full(m, order, np.uint64), np.ones(m, bool)
            for j in range(order):
                h = h * np.uint64(0x100000001B3) + line[j: j + m]
                if 0 < j < order - 1:
                    inner &= some[j: j + m]
            if order == 2:
                inner &= some[:m] | some[1: 1 + m]
            at = np.flatnonzero(inner)
            grams.append(K.mix(h[at]))
            orders.append(np.full(len(at), order, np.int8))
            of.append(word[np.where(some[at], at, at + 1)])
        self.gram, self.order, self.of = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((grams, np.uint64), (orders, np.int8), (of, np.int64)))


def count_ngrams(rows: DataFrame) -> DataFrame:
    """(lang, n, gram, count) over all rows (text, lang), summed in each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.text_chunks(batch, "text"):
                names = part.column("lang").dictionary_encode()
                lang = np.asarray(names.indices)
                words = Words(part.column("text"), lang)
                times = np.bincount(words.which, minlength=len(words.own))
                lang = lang[words.text[words.own]]
                ids, first, at = np.unique(words.gram, return_index=True, return_inverse=True)
                for k in np.unique(lang).tolist():
                    mine = lang[words.of] == k
                    count = np.bincount(at[mine], times[words.of[mine]], minlength=len(ids)).astype(np.int64)
                    some = np.flatnonzero(count)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names.dictionary[k].as_py()] * len(some), pa.string()), pa.array(words.order[first[some]].astype(np.int32)),
                         pa.array(ids[some].view(np.int64)), pa.array(count[some])], ["lang", "n", "gram", "count"])

    return rows.select("text", "lang").mapInArrow(K.tidy(run), "lang string, n int, gram long, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))


class Filters:
    """The bit-sliced table: ``slots[s]`` has bit l set if an n-gram of language
    l hashes to slot s (64 languages a word)."""

    def __init__(self, langs: list[str], slots: np.ndarray):
        self.langs, self.slots = langs, slots
        fill = [(slots[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(langs))] if len(slots) else []
        self.false_rate = np.array(fill, float) ** HASHES

    def languages(self, gram: np.ndarray) -> np.ndarray:
        """Bitmask words of the languages that claim each n-gram."""
        found = self.slots[slot_of(gram, 0, len(self.slots))]
        for k in range(1, HASHES):
            found = found & self.slots[slot_of(gram, k, len(self.slots))]
        return found

    def score(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Best language and its share of the corrected popcounts, for each text."""
        words = Words(column)
        n, letters = words.n_texts, words.letters
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        found, counts = self.languages(words.gram), np.zeros((n, len(self.langs)))

        def of_texts(grams: np.ndarray) -> np.ndarray:
            return np.bincount(words.text, np.bincount(grams, minlength=len(words.own))[words.which], minlength=n)

        for i in range(len(self.langs)):
            hit = (found[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(bool)
            counts[:, i] = of_texts(words.of[hit])
        total = of_texts(words.of)[:, None]
        true = np.clip((counts - total * self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, None)
        best = true.argmax(1)
        score = true[np.arange(n), best] / np.maximum(true.sum(1), 1e-9)
        return [self.langs[b] if k else "und" for b, k in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters > 0, np.minimum(score, 1.0), 0.0)


def slot_of(gram: np.ndarray, k: int, size: int) -> np.ndarray:
    return (K.mix(gram + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) & np.uint64(size - 1)).astype(np.int64)


def train(rows: DataFrame) -> Filters:
    """Filters from rows (text, lang).  What reaches the driver is the slot
    table: at most 1 / MIN_SHARE n-grams for each order and language."""
    counts = K.written(count_ngrams(rows.where("lang IS NOT NULL AND text IS NOT NULL")), "ngrams")
    sums = counts.groupBy("lang", "n").agg(F.sum("count").alias("all"))
    rates = counts.join(F.broadcast(sums), ["lang", "n"]).withColumn("rate", F.col("count") / F.col("all"))  # a row for each language and order
    top = rates.groupBy("gram").agg(F.max("rate").alias("top"))
    kept = K.written(rates.where(F.col("rate") >= MIN_SHARE).join(top, "gram").where(F.col("rate") >= MARGIN * F.col("top")).select("lang", "gram"), "kept-ngrams")
    langs = sorted(r["lang"] for r in kept.select("lang").distinct().collect())
    n_keys = kept.select("gram").distinct().count()
    if not n_keys:
        return Filters([], np.zeros((0, 1), np.uint64))
    size, number = 1 << (n_keys * SLOTS_PER_KEY - 1).bit_length(), {name: i for i, name in enumerate(langs)}

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = np.asarray(batch.column("gram")).view(np.uint64)
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            at = np.concatenate([slot_of(gram, k, size) for k in range(HASHES)])
            lang = np.tile(lang, HASHES)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(lang // 64), pa.array((np.uint64(1) << (lang % 64).astype(np.uint64)).view(np.int64))], ["slot", "word", "bits"])

    table = np.zeros((size, -(-len(langs) // 64)), np.uint64)
    filled = kept.mapInArrow(K.tidy(slots), "slot long, word long, bits long").groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table[np.asarray(filled["slot"]), np.asarray(filled["word"])] = np.asarray(filled["bits"]).view(np.uint64)
    return Filters(langs, table)


def predict(docs: DataFrame, filters: Filters, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """All columns of ``docs`` but the text in ``row``, with lang_pred and score,
    and the text itself only if asked for."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(filters)  # bounded by MIN_SHARE
    rows = docs.select(K.others(docs, text_col), F.col(text_col).alias("text"))
    kept = ["row", "text"] if keep_text else ["row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.text_chunks(batch, "text"):
                lang, score = held.value.score(part.column("text"))
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*kept, "lang_pred", "score"])

    return rows.mapInArrow(K.tidy(run), K.schema(rows.select(*kept), "lang_pred string, score double"))


def held_out(id_col: str = "doc_id"):
    """Rows that no filter learns from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """Train on the rows not held out and predict every row: ``row`` (all
    columns of ``docs`` but the text), held_out, lang_pred, score, and the text
    if asked for."""
    rows = docs.where(~held_out(id_col)).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    found = predict(docs, train(rows), text_col, keep_text)
    return found.withColumn("held_out", held_out(f"row.`{id_col}`"))


def drop_unidentified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose language can't be told (``und``); the
    kept rows carry the predicted language where they had none."""
    known = identify(docs, text_col, lang_col, id_col, keep_text=True).where("lang_pred != 'und'")

    def column(c):
        if c == text_col:
            return F.col("text").alias(c)
        return (F.coalesce(F.col(f"row.`{c}`"), F.col("lang_pred")) if c == lang_col else F.col(f"row.`{c}`")).alias(c)

    return known.select(*map(column, docs.columns))
