import numpy as np
import pytest

from draftspark.llm import pieces as M


@pytest.fixture(scope="module")
def vocabulary():
    return M.read_vocabulary()


def brute(text, vocabulary):
    pieces, scores, kinds = vocabulary
    table = {p: (i, s) for i, (p, s) in enumerate(zip(pieces, scores)) if kinds[i] == "piece"}
    lowest = min(s for _, s in table.values()) - M.UNKNOWN_PENALTY
    byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if kinds[i] == "byte"}
    if not text:
        return []
    chars = ["▁" if c == " " else "literal" if c == "▁" else c for c in " " + text]
    best, back = [0.0], [None]
    for i in range(1, len(chars) + 1):
        high, step, single = -float("inf"), (1, None), False
        for size in range(min(i, 16), 0, -1):
            found = table.get("".join(chars[i - size:i])) if "literal" not in chars[i - size:i] else None
            if found:
                single |= size == 1
                if best[i - size] + found[1] > high:
                    high, step = best[i - size] + found[1], (size, found[0])
        if not single and best[i - 1] + lowest > high:
            high, step = best[i - 1] + lowest, (1, None)
        best.append(high)
        back.append(step)
    out, i = [], len(chars)
    while i:
        size, piece = back[i]
        c = "▁" if chars[i - 1] == "literal" else chars[i - 1]
        out += [piece] if piece is not None else [byte[b] for b in reversed(c.encode("utf-8", "surrogateescape"))]
        i -= size
    return out[::-1]


ODD = ["a  b", "  lead", "tab\there\nnl", "日本語 \U0001F389 x", "▁lit▁", "x" * 50, " ", "\n", "é" * 9, "", b"\xff\xfeab".decode("utf-8", "surrogateescape"), "q" * 700, "   " * 200, "\x00a"]


def test_side_by_side_viterbi_matches_brute_force(documents, vocabulary):
    texts = [r["text"] for r in documents.limit(25).collect()] + ODD
    own = M.Pieces(*vocabulary)
    ids, counts = own.encode(texts)
    ends = np.cumsum(counts)
    for t, a, b in zip(texts, ends - counts, ends):
        assert ids[a:b].tolist() == brute(t, vocabulary)
    data, to = own.decode(ids, counts)
    for t, a, b in zip(texts, [0, *to[:-1]], to):
        assert data[a:b].tobytes() == t.encode("utf-8", "surrogateescape")


def test_pieces_that_cross_words(vocabulary):
    """A vocabulary whose pieces span spaces: texts are solved whole."""
    pieces, scores, kinds = (["<unk>", *[f"<0x{b:02X}>" for b in range(256)], "a", "b", "▁", "a▁b", "▁a", "ab"],
                             [0.0] * 257 + [-3.0, -3.0, -3.0, -1.0, -2.0, -2.5], ["control"] + ["byte"] * 256 + ["piece"] * 6)
    own = M.Pieces(pieces, scores, kinds)
    assert own.whole
    for t in ("a b", "aa bab a b", "b a", "ccc a b"):
        assert own.encode([t])[0].tolist() == brute(t, (pieces, scores, kinds))


def test_round_trip(documents, odd, empty):
    for df in (documents, odd):
        got = M.decode(M.encode(df)).select("row.row.doc_id", "text").collect()
        want = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert M.decode(M.encode(empty)).count() == 0
