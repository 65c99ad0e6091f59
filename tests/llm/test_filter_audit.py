import re
from collections import Counter
from itertools import permutations

import numpy as np

from draftspark.llm import filter_audit as M


def fails(rows):
    """Bits per row by the definitions, one row at a time."""
    low = {}
    for r in rows:
        if r["doc_id"] is not None:
            t = r["text"] or ""
            low[t] = min(low.get(t, r["doc_id"]), r["doc_id"])
    for r in rows:
        text = r["text"] or ""
        w = re.findall("[^\x20\x09-\x0D]+", text)
        yield (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
               bool(re.search("[#$%&*|]", text)), r["doc_id"] is not None and r["doc_id"] > low[text])


def brute(rows, labels):
    good = {r["doc_id"] for r in labels if r["quality"] == 1 and r["doc_id"] is not None}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1 and r["doc_id"] is not None}
    kinds = list(fails(rows))
    shapley = Counter()
    out = []
    parts = {r["source"] or "" for r in rows}
    for order in permutations("ABCDE"):
        for part in parts:
            left = [(r, f) for r, f in zip(rows, kinds, strict=True) if (r["source"] or "") == part]
            every, gone = left, []
            for step, name in enumerate(order, 1):
                i = "ABCDE".index(name)
                here = [(r, f) for r, f in left if f[i]]
                left = [(r, f) for r, f in left if not f[i]]
                shapley[part, name] += len(here)
                out.append([part, "".join(order), step, len(left), len(here), sum(f[i] for _, f in gone), sum(f[i] and sum(f) == 1 for _, f in every),
                            sum(r["doc_id"] in good for r, _ in here), sum(r["doc_id"] in toxic for r, _ in here)])
                gone += here
    return sorted((*o, shapley[o[0], o[1][o[2] - 1]]) for o in out)


def check(docs, labels):
    got = sorted(tuple(r) for r in M.audit(M.failures(docs, labels)).collect())
    assert got == brute(docs.collect(), labels.collect())


def test_documents_match_brute_force(llm, documents):
    check(documents, llm.read.parquet("/root/testdata/sf0.001/labels.parquet"))


def test_odd_rows(llm, odd, empty):
    labels = llm.createDataFrame([(1, 1, 0), (1, 0, 1), (5, 1, 1), (None, 1, 1), (9, None, None), (12, 0, 1)], "doc_id long, quality int, toxic int")
    check(odd, labels)
    mixed = odd.selectExpr("doc_id", "text", "CASE WHEN doc_id % 2 = 0 THEN 'a' WHEN doc_id % 3 = 0 THEN '' END AS source", "row", "n_chars AS n_words")
    check(mixed, labels)
    assert M.audit(M.failures(empty, labels)).count() == 0


def test_counts_of_odd_texts(odd):
    got = sorted(((r["row"]["doc_id"], r["n_words"], r["n_distinct"], r["n_capitals"], r["n_chars"], r["n_symbols"]) for r in M.text_counts(odd).collect()), key=str)
    want = []
    for r in odd.collect():
        text = r["text"] or ""
        w = re.findall("[^\x20\x09-\x0D]+", text)
        want.append((r["doc_id"], len(w), len(set(w)), len(re.findall("[A-Z]", text)), len(text), len(re.findall("[#$%&*|]", text))))
    assert got == sorted(want, key=str)


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    """The table verifies the bytes: with one hash for all words the distinct counts stay right."""
    words = [b"a", b"b", b"a", b"longer word", b"longer w0rd", b"longer word", b"eightch1", b"eightch2", b"eightch1x"]
    start = np.cumsum([0] + [len(w) for w in words[:-1]])
    data = np.frombuffer(b"".join(words) + bytes(16), np.uint8)
    monkeypatch.setattr(M.K, "hash_spans", lambda data, starts, lengths, seed=0: np.zeros(len(starts), np.uint64))
    text = np.array([0, 0, 0, 0, 0, 0, 1, 1, 1])
    got = M.distinct_words(data, start, np.array([len(w) for w in words]), text, 2)
    assert got.tolist() == [4, 3]
