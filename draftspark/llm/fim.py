"""Fill-in-middle transformation by displacement scatter.

A text is cut at two of its units (runs of ASCII letters, or single other code
points) into prefix, middle and suffix; the output is ``<P>``prefix``<S>``suffix
``<M>``middle (psm) or ``<S>``suffix``<P>``prefix``<M>``middle (spm).  All texts of a
batch are rearranged at once: the cuts are read off a scan of the bytes, a
difference array holds at each cut by how much the shift of the following bytes
changes, its cumulative sum is the shift of every byte, and one scatter places
them.  ``restore`` finds the three marks in an output and gathers by the inverse
shifts.

Which cuts and which form a row gets follows from the hash of its id alone, so
tasks that run again give the same rows.

Defined results: a null text counts as empty; an empty text, one that holds a
mark, and the share of rows that is left as it is have the form ``plain`` and
null lengths; rows with a null id are hashed as an empty id; repeated rows give
repeated results; other columns travel in ``row`` whatever their names.  An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

#: The marks.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = PREFIX + SUFFIX + MIDDLE
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ["plain", "psm", "spm"]
RATE, SPM_SHARE = 90, 20  # per cent of rows that are rearranged; of these per cent in the form spm


def marks_at(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the marks, and for each its letter; none across texts."""
    n = int(offsets[-1])
    at = np.flatnonzero(data[:n] == ord("<"))
    letter = data[at + 1]
    hit = ((letter == PREFIX[1]) | (letter == SUFFIX[1]) | (letter == MIDDLE[1])) & (data[at + 2] == ord(">"))
    at = at[hit]
    inside = at + 3 <= offsets[np.searchsorted(offsets, at, "right")] if len(at) else np.zeros(0, bool)
    return at[inside], data[at[inside] + 1]


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which a unit of some text starts."""
    body = data[: int(offsets[-1])]
    letter = ((body | np.uint8(32)) - np.uint8(97)) < 26
    joined = np.zeros(len(body), bool)
    joined[1:] = letter[1:] & letter[:-1]
    edge = offsets[:-1]
    joined[edge[edge < len(body)]] = False
    return np.flatnonzero(((body & np.uint8(0xC0)) != 0x80) & ~joined)


def shifts(n: int, at: list[np.ndarray], by: list[np.ndarray]) -> np.ndarray:
    """The shift of each of ``n`` bytes when it changes by ``by`` from ``at`` on."""
    step = np.zeros(n + 1, np.int64)
    for a, b in zip(at, by, strict=True):
        np.add.at(step, a, b)
    return np.cumsum(step[:n])


def rearrange(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs (bytes, offsets) of texts cut at the byte positions ``first`` <= ``second``."""
    start, end = offsets[:-1], offsets[1:]
    moved = form != PLAIN
    out_offsets = np.concatenate([[0], np.cumsum(end - start + np.where(moved, len(MARKS), 0))])
    base = out_offsets[:-1] - start
    p, m, s = first - start, second - first, end - second
    to_p = base + np.where(form == PSM, 3, np.where(form == SPM, s + 6, 0))
    to_m = base + np.where(moved, s + 9, 0)
    to_s = base + np.where(form == PSM, 6 - m, np.where(form == SPM, 3 - p - m, 0))
    # the shift goes back to zero at the end of a text, as the next one starts anew
    shift = shifts(int(offsets[-1]), [start, first, second, end], [to_p, to_m - to_p, to_s - to_m, -to_s])
    out = np.zeros(int(out_offsets[-1]) + 16, np.uint8)
    out[np.arange(len(shift)) + shift] = data[: len(shift)]
    o, s_first = out_offsets[:-1][moved], form[moved] == SPM
    prefix_at = o + np.where(s_first, s[moved] + 3, 0)
    suffix_at = o + np.where(s_first, 0, p[moved] + 3)
    middle_at = o + p[moved] + s[moved] + 6
    for mark, at in ((PREFIX, prefix_at), (SUFFIX, suffix_at), (MIDDLE, middle_at)):
        for j, byte in enumerate(mark):
            out[at + j] = byte
    return out, out_offsets


def put_back(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts (bytes, offsets) of which outputs were made."""
    start, end = offsets[:-1], offsets[1:]
    moved = form != PLAIN
    at, letter = marks_at(data, offsets)
    text = np.searchsorted(offsets, at, "right") - 1
    where = {}
    for mark in (PREFIX, SUFFIX, MIDDLE):
        own = (letter == mark[1]) & moved[text]
        where[mark] = start.copy()
        where[mark][text[own]] = at[own]
    a, b = np.minimum(where[PREFIX], where[SUFFIX]), np.maximum(where[PREFIX], where[SUFFIX])
    c = where[MIDDLE]
    one, two, three = np.where(moved, b - a - 3, 0), np.where(moved, c - b - 3, 0), np.where(moved, end - c - 3, 0)
    p, s, m = np.where(form == SPM, two, one), np.where(form == SPM, one, two), three
    size = np.where(moved, p + m + s, end - start)
    out_offsets = np.concatenate([[0], np.cumsum(size)])
    base = start - out_offsets[:-1]
    from_p = base + np.where(form == PSM, 3, np.where(form == SPM, s + 6, 0))
    from_m = base + np.where(moved, s + 9, 0)
    from_s = base + np.where(form == PSM, 6 - m, np.where(form == SPM, 3 - p - m, 0))
    o, o_end = out_offsets[:-1], out_offsets[1:]
    first, second = o + np.where(moved, p, 0), o + np.where(moved, p + m, 0)
    shift = shifts(int(out_offsets[-1]), [o, first, second, o_end], [from_p, from_m - from_p, from_s - from_m, -from_s])
    return data[np.arange(len(shift)) + shift], out_offsets


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    n = int(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[:n]))).cast(pa.string())


def fill_in_middle(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", salt: str = "1", rate: int = RATE, spm: int = SPM_SHARE) -> DataFrame:
    """row (the other columns and the id), n (units), form, prefix_chars,
    middle_chars (code points; null if plain) and output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.text_chunks(batch, "text"):
                data, offsets = K.utf8(part.column("text"))
                draw = [np.asarray(part.column(f"h{i}")) for i in range(1, 5)]
                unit = unit_starts(data, offsets)
                head = np.searchsorted(unit, offsets)
                n = np.diff(head)
                x, y = draw[0] % (n + 1), draw[1] % (n + 1)
                unit = np.append(unit, offsets[-1])

                def cut(k, head=head, n=n, unit=unit, offsets=offsets):
                    return np.where(k == n, offsets[1:], unit[np.minimum(head[:-1] + k, len(unit) - 1)])

                first, second = cut(np.minimum(x, y)), cut(np.maximum(x, y))
                marked = np.zeros(len(n), bool)
                marked[np.searchsorted(offsets, marks_at(data, offsets)[0], "right") - 1] = True
                plain = (n == 0) | marked | (draw[2] % 100 >= rate)
                form = np.where(plain, PLAIN, np.where(draw[3] % 100 < spm, SPM, PSM))
                out, out_offsets = rearrange(data, offsets, np.where(plain, offsets[:-1], first), np.where(plain, offsets[:-1], second), form)
                points = np.concatenate([[0], np.cumsum((data[: offsets[-1]] & np.uint8(0xC0)) != 0x80)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(n), pa.array(np.array(FORMS, object)[form], pa.string()), pa.array(points[first] - points[offsets[:-1]], pa.int64(), mask=plain),
                     pa.array(points[second] - points[first], pa.int64(), mask=plain), _strings(out, out_offsets)],
                    ["row", "n", "form", "prefix_chars", "middle_chars", "output"])

    mark = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(mark, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(K.others(docs, text_col), F.col(text_col).alias("text"), *draws)
    return rows.mapInArrow(K.tidy(run), K.schema(rows.select("row"), "n long, form string, prefix_chars long, middle_chars long, output string"))


def restore(made: DataFrame) -> DataFrame:
    """``made`` (with the columns output and form) and the text of each row,
    rebuilt from these two columns alone, as ``restored``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.text_chunks(batch, "output"):
                data, offsets = K.utf8(part.column("output"))
                form = np.array([FORMS.index(f) for f in part.column("form").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, _strings(*put_back(data, offsets, form))], [*part.schema.names, "restored"])

    return made.mapInArrow(K.tidy(run), K.schema(made, "restored string"))
