import hashlib
import re

import numpy as np
import pytest

from draftspark.llm import fim as M


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def check(docs, id_of):
    made = M.restore(M.fill_in_middle(docs))
    got = [(id_of(r), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in made.collect()]
    want = [brute(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return {r[2] for r in got}


def test_documents_match_brute_force(documents):
    assert check(documents, lambda r: r["row"]["doc_id"]) == {"plain", "psm", "spm"}


def test_odd_rows(odd, empty):
    check(odd, lambda r: r["row"]["doc_id"])
    assert M.restore(M.fill_in_middle(empty)).count() == 0
    row = M.fill_in_middle(odd).select("row.*")
    assert row.columns == [c for c in odd.columns if c != "text"]


@pytest.mark.parametrize("seed", range(6))
def test_rearranged_texts_come_back(seed):
    """Random texts near the marks, with any cut in any form; nothing crosses texts."""
    rng = np.random.default_rng(seed)
    texts = ["".join(rng.choice(list("<PSM>aé日 "), rng.integers(0, 12))) for _ in range(200)]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    data = np.frombuffer(b"".join(raw) + bytes(16), np.uint8).copy()
    marked = np.zeros(len(texts), bool)
    marked[np.searchsorted(offsets, M.marks_at(data, offsets)[0], "right") - 1] = True
    assert marked.tolist() == [any(m in t for m in ("<P>", "<S>", "<M>")) for t in texts]
    form = np.where(marked | (np.diff(offsets) == 0), M.PLAIN, rng.integers(1, 3, len(texts)))
    cuts = np.sort(rng.integers(0, np.diff(offsets) + 1, (2, len(texts))), axis=0) + offsets[:-1]
    out, out_offsets = M.rearrange(data, offsets, np.where(form == M.PLAIN, offsets[:-1], cuts[0]), np.where(form == M.PLAIN, offsets[:-1], cuts[1]), form)
    for i in range(len(texts)):
        a, b, c, d = offsets[i], cuts[0][i], cuts[1][i], offsets[i + 1]
        p, m, s = (data[x:y].tobytes() for x, y in ((a, b), (b, c), (c, d)))
        want = [raw[i], b"<P>" + p + b"<S>" + s + b"<M>" + m, b"<S>" + s + b"<P>" + p + b"<M>" + m][form[i]]
        assert out[out_offsets[i]:out_offsets[i + 1]].tobytes() == want
    back, back_offsets = M.put_back(out, out_offsets, form)
    assert back.tobytes() == b"".join(raw) and (back_offsets == offsets).all()
