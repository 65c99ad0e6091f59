"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the
pieces drives a single-pass Viterbi.

The automaton reads a text once; at each character its state's output links
list every piece that ends there, longest first, and each relaxes the best score
of that position (strictly better wins, so ties go to the longer last piece).
A character that is no piece by itself costs the lowest score less ten and is
written as byte pieces.  The vocabulary, its scores and its byte pieces are read
from a public model file, whose path is a parameter; nothing is trained.  Scores
are used as the file states them, so a file made for merges gives the
segmentation of the highest total score, not the merge order's.

No piece of such a file spans a word start (a space mark after another
character) or a character found in no longer piece; where the vocabulary
confirms that, texts are cut there, equal cuts of a chunk of texts are solved
once, and many cuts are read side by side.

Defined results: null and empty texts have no tokens and decode to the empty
text; malformed UTF-8 bytes, literal space marks and unknown characters are
encoded byte by byte, so every text decodes to itself.  An empty table gives an
empty result.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
SIDE_BY_SIDE = 256       # characters of the longest cut that is solved beside others
CELLS = 1 << 20          # scores held at once
NEVER, FREE = -float("inf"), np.uint64(0xFFFFFFFFFFFFFFFF)
MARK, INNER, OTHER = 0, 1, 2
LITERAL = 0x110000       # stands for a space mark that is in the text itself


def read_vocabulary(path: str = MODEL) -> tuple[list[str], list[float], list[str]]:
    """(pieces, scores, kinds) of a model file; kinds: piece, byte or control."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    kind = ["byte" if model.is_byte(i) else "control" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "piece" for i in ids]
    return [model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], kind


class Pieces:
    """The automaton of a vocabulary.  States are numbers; edges are one hash
    table keyed by state and character; a state's output links are flattened
    into a run of piece ends, longest first."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        self.byte_ids = np.zeros(256, np.int32)
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == "byte":
                self.byte_ids[int(p[3:5], 16)] = i
        spelled = [bytes([int(p[3:5], 16)]) if k == "byte" else b"" if k == "control" else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.piece_size = np.array([len(x) for x in spelled], np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_data = np.frombuffer(b"".join(spelled), np.uint8)
        own = [(p, s, i) for i, (p, s, k) in enumerate(zip(pieces, scores, kinds, strict=True)) if k == "piece"]
        self.unknown = min((s for _, s, _ in own), default=0.0) - UNKNOWN_PENALTY
        self._build(own)
        # kind of a character: a space mark, part of some longer piece, or neither
        self.kind = np.full(0x110000, OTHER, np.uint8)
        for c in {c for p, _, _ in own if len(p) > 1 for c in p}:
            self.kind[ord(c)] = INNER
        self.kind[ord(SPACE)] = MARK
        self.whole = any(SPACE in p.lstrip(SPACE) for p, _, _ in own)  # then texts can't be cut

    def _build(self, own: list[tuple[str, float, int]]) -> None:
        edges: dict[int, int] = {}
        children: list[list[tuple[int, int]]] = [[]]
        ends: list[tuple[tuple[int, float, int], ...]] = [()]
        for piece, score, number in own:
            state = 0
            for c in map(ord, piece):
                key = state << 21 | c
                if key not in edges:
                    edges[key] = len(children)
                    children[state].append((c, len(children)))
                    children.append([])
                    ends.append(())
                state = edges[key]
            ends[state] = ((len(piece), score, number),)
        fail, queue = [0] * len(children), deque(s for _, s in children[0])
        while queue:
            state = queue.popleft()
            for c, child in children[state]:
                back = fail[state]
                while back and back << 21 | c not in edges:
                    back = fail[back]
                fail[child] = edges.get(back << 21 | c, 0)
                ends[child] += ends[fail[child]]
                queue.append(child)
        self.edges, self.ends, self.fail = edges, ends, np.array(fail, np.int32)
        count = np.array([len(e) for e in ends], np.int32)
        self.end_count, self.end_first = count, np.cumsum(count, dtype=np.int64) - count
        flat = [x for e in ends for x in e]
        self.end_size, self.end_score, self.end_id = np.array([x[0] for x in flat], np.int32), np.array([x[1] for x in flat], float), np.array([x[2] for x in flat], np.int32)
        self.end_single = np.array([bool(e) and e[-1][0] == 1 for e in ends])
        # open addressing over the edges, at most half full
        bits = max(4, (2 * len(edges)).bit_length())
        keys, values = np.array(list(edges), np.uint64), np.array(list(edges.values()), np.int32)
        self.table_keys, self.table_values, self.bits = np.full(1 << bits, FREE), np.zeros(1 << bits, np.int32), bits
        slot, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            open_ = rest[self.table_keys[slot[rest]] == FREE]
            self.table_keys[slot[open_]] = keys[open_]  # of rivals for a slot the last wins
            rest = rest[self.table_keys[slot[rest]] != keys[rest]]
            slot[rest] = (slot[rest] + 1) & ((1 << bits) - 1)
        self.table_values[slot] = values

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next state of each (state, character): the edge, else that of the
        failure state, and so on up to the root."""
        state, rest = state.copy(), np.arange(len(state))
        while len(rest):
            keys = state[rest].astype(np.uint64) << np.uint64(21) | char[rest].astype(np.uint64)
            slot = self._slot(keys)
            found = self.table_keys[slot]
            hit = found == keys
            moved = np.flatnonzero(~hit & (found != FREE))
            while len(moved):  # another edge's slot: probe on
                slot[moved] = (slot[moved] + 1) & ((1 << self.bits) - 1)
                found[moved] = self.table_keys[slot[moved]]
                hit[moved] = found[moved] == keys[moved]
                moved = moved[~hit[moved] & (found[moved] != FREE)]
            state[rest[hit]] = self.table_values[slot[hit]]
            rest = rest[~hit]
            rest = rest[state[rest] != 0]
            state[rest] = self.fail[state[rest]]
        return state

    def viterbi(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all cuts, pieces of each cut) of the best segmentations of
        many cuts, read side by side in one pass each.  A piece below zero
        stands for the unknown character -1 - code."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        n, most = len(starts), int(sizes[0])
        best = np.full((most + 1, n), NEVER)
        best[0] = 0.0
        took = np.full((most + 1, n), -1, np.int32)
        state, active = np.zeros(n, np.int64), n
        for i in range(1, most + 1):
            active = int(np.searchsorted(-sizes, -i, "right"))  # cuts of i characters or more come first
            state = self.step(state[:active], codes[starts[:active] + i - 1])
            count, first = self.end_count[state], self.end_first[state]
            high, chosen = np.full(active, NEVER), np.full(active, -1, np.int32)
            rows, k = np.flatnonzero(count), 0
            while len(rows):
                end = first[rows] + k
                score = best[i - self.end_size[end], rows] + self.end_score[end]
                better = score > high[rows]
                high[rows[better]], chosen[rows[better]] = score[better], end[better]
                k += 1
                rows = rows[count[rows] > k]
            rows = np.flatnonzero(~self.end_single[state])
            rows = rows[best[i - 1, rows] + self.unknown > high[rows]]
            high[rows], chosen[rows] = best[i - 1, rows] + self.unknown, -1
            best[i, :active], took[i, :active] = high, chosen
        # back from the ends, all cuts side by side
        at, rows, found = sizes.copy(), np.arange(n), []
        while len(rows):
            end = took[at[rows], rows]
            unknown = -1 - codes[starts[rows] + at[rows] - 1].astype(np.int64)
            found.append((rows, np.where(end >= 0, self.end_id[end], unknown)))
            at[rows] -= np.where(end >= 0, self.end_size[end], 1)
            rows = rows[at[rows] > 0]
        total = np.zeros(n, np.int64)
        for rows, _ in found:
            total[rows] += 1
        last = np.cumsum(total)
        out = np.empty(int(last[-1]), np.int64)
        for k, (rows, piece) in enumerate(found):
            out[last[rows] - 1 - k] = piece
        # into the order of the cuts given
        counts = np.empty(n, np.int64)
        counts[order] = total
        put = np.cumsum(counts) - counts
        moved = np.empty_like(out)
        moved[np.arange(len(out)) + np.repeat(put[order] - (last - total), total)] = out
        return moved, counts

    def long_viterbi(self, codes: list[int]) -> list[int]:
        """The same for one long cut."""
        edges, fail, ends, state = self.edges, self.fail, self.ends, 0
        best, took = [0.0], [None]
        for i, c in enumerate(codes, 1):
            following = edges.get(state << 21 | c)
            while following is None and state:
                state = int(fail[state])
                following = edges.get(state << 21 | c)
            state = following or 0
            high, step = NEVER, None
            for end in ends[state]:
                score = best[i - end[0]] + end[1]
                if score > high:
                    high, step = score, end
            if (not ends[state] or ends[state][-1][0] > 1) and best[i - 1] + self.unknown > high:
                high, step = best[i - 1] + self.unknown, None
            best.append(high)
            took.append(step)
        out, i = [], len(codes)
        while i:
            step = took[i]
            out.append(-1 - codes[i - 1] if step is None else step[2])
            i -= 1 if step is None else step[0]
        return out[::-1]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(piece numbers of all texts, their count for each text).  Bytes that
        are no UTF-8 come as lone surrogates."""
        codes = np.frombuffer("".join([" " + t if t else "" for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 if t else 0 for t in texts])
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        literal = codes == ord(SPACE)
        codes = np.where(codes == 0x20, np.uint32(ord(SPACE)), codes)
        codes[literal] = LITERAL
        kind = self.kind[np.minimum(codes, 0x10FFFF)]
        kind[literal] = OTHER
        cut = np.zeros(len(codes) + 1, bool)
        cut[ends] = cut[0] = True
        if not self.whole:
            cut[:-1] |= kind == OTHER
            cut[1:-1] |= (kind[:-1] == OTHER) | (kind[1:] == MARK) & (kind[:-1] != MARK)
        starts = np.flatnonzero(cut[:-1])
        sizes = np.diff(np.append(starts, len(codes)))
        own, which = self._distinct(codes, starts, sizes)
        pieces, counts = self._solve(codes, starts[own], sizes[own])
        first = np.cumsum(counts) - counts
        n = counts[which]
        flat = pieces[np.arange(int(n.sum())) + np.repeat(first[which] - (np.cumsum(n) - n), n)]
        return flat, np.diff(np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, np.concatenate([[0], ends]))])

    @staticmethod
    def _distinct(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(one cut of each content, which of them each cut is)."""
        padded = np.concatenate([codes, np.zeros(4, np.uint32)])
        every, of = np.arange(len(codes)), np.repeat(np.arange(len(starts)), sizes)
        for seed in range(8):
            name = K.hash_spans(padded.view(np.uint8), starts * 4, sizes * 4, seed)
            _, own, which = np.unique(name, return_index=True, return_inverse=True)
            like = own[which]
            if (sizes[like] == sizes).all() and (codes[every - starts[of] + starts[like][of]] == codes).all():
                return own, which
        return np.arange(len(starts)), np.arange(len(starts))

    def _solve(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``viterbi`` over groups of cuts of like size, then byte pieces for
        unknown characters."""
        order = np.argsort(sizes, kind="stable")
        parts, counts = [], np.zeros(len(starts), np.int64)
        a = 0
        while a < len(order):
            b = int(np.searchsorted(sizes[order], max(sizes[order[a]] * 2, 8), "right"))
            b = min(b, a + max(1, CELLS // int(sizes[order[b - 1]] + 1)))
            some = order[a:b]
            if sizes[some[0]] > SIDE_BY_SIDE:
                b = a + 1
                found = np.array(self.long_viterbi(codes[starts[some[0]]: starts[some[0]] + sizes[some[0]]].tolist()), np.int64)
                counts[some[0]] = len(found)
            else:
                found, counts[some] = self.viterbi(codes, starts[some], sizes[some])
            parts.append(found)
            a = b
        found, n = np.concatenate(parts), counts[order]
        for_unknown = {c: _bytes(-1 - c) for c in np.unique(found[found < 0]).tolist()}
        if for_unknown:
            times = np.ones(len(found), np.int64)
            at = np.flatnonzero(found < 0)
            times[at] = [len(for_unknown[c]) for c in found[at].tolist()]
            spelled = b"".join(for_unknown[c] for c in found[at].tolist())
            n = np.add.reduceat(times, np.cumsum(n) - n)
            unknown = np.repeat(found < 0, times)
            found = np.repeat(found, times)
            found[unknown] = self.byte_ids[np.frombuffer(spelled, np.uint8)]
        counts[order] = n
        put = np.cumsum(counts) - counts
        out = np.empty(len(found), np.int32)
        out[np.arange(len(found)) + np.repeat(put[order] - (np.cumsum(n) - n), n)] = found
        return out, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, end of each) from their piece numbers."""
        size = self.piece_size[ids].copy()
        skip = np.zeros(len(ids), np.int64)
        heads = (np.cumsum(counts) - counts)[counts > 0]
        skip[heads] = 1  # the space put before a text
        size -= skip
        to = np.cumsum(size)
        data = self.piece_data[np.arange(int(to[-1]) if len(to) else 0) + np.repeat(self.piece_start[ids] + skip - (to - size), size)]
        return data, np.concatenate([[0], to])[np.cumsum(counts)]


def _bytes(code: int) -> bytes:
    return SPACE.encode() if code == LITERAL else chr(code).encode("utf-8", "surrogateescape")


@functools.lru_cache(2)
def _automaton(held) -> Pieces:
    return Pieces(*held)


def _of(value: tuple) -> Pieces:
    """One automaton a worker process for each vocabulary."""
    return _automaton(value)


def _vocabulary(df: DataFrame, model: str):
    pieces, scores, kinds = read_vocabulary(model)
    return df.sparkSession.sparkContext.broadcast((tuple(pieces), tuple(scores), tuple(kinds)))  # a fixed vocabulary


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``row`` (all columns of ``docs`` but the text) and ids (array<int>)."""
    held = _vocabulary(docs, model)
    rows = docs.select(K.others(docs, text_col), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _of(held.value)
        for batch in batches:
            for part in K.text_chunks(batch, "text"):
                data, offsets = K.utf8(part.column("text"))
                raw, cut = data.tobytes(), offsets.tolist()
                ids, counts = own.encode([raw[a:b].decode("utf-8", "surrogateescape") for a, b in zip(cut[:-1], cut[1:], strict=True)])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("row"), lists], ["row", "ids"])

    return rows.mapInArrow(K.tidy(run), K.schema(rows.select("row"), "ids array<int>"))


def decode(rows: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``row`` (all columns of ``rows`` but the ids), ids and text, decoded.
    Null ids are skipped, a null list gives the empty text."""
    held = _vocabulary(rows, model)
    left = rows.select(K.others(rows, ids_col), F.coalesce(F.filter(F.col(ids_col).cast("array<int>"), lambda i: i.isNotNull()), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _of(held.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                ids = part.column("ids")
                counts = np.diff(ids.offsets.to_numpy())
                data, ends = own.decode(ids.flatten().to_numpy(zero_copy_only=False), counts)
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                texts = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([part.column("row"), ids, texts.cast(pa.string(), safe=False)], ["row", "ids", "text"])

    return left.mapInArrow(K.tidy(run), K.schema(left, "text string"))
