import re

import numpy as np
import pyarrow as pa
import pytest

from draftspark.llm import circulant as M


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    low = {}
    for (i, _), c in zip(rows, label, strict=True):
        low[c] = min([x for x in (low.get(c), i) if x is not None], default=None)
    return sorted(((i, len(s), low[c]) for (i, _), s, c in zip(rows, sets, label, strict=True)), key=str)


def check(df):
    want = brute([(r[0], r[1]) for r in df.select("doc_id", "text").collect()])
    got = sorted(((r["doc_id"], r["n"], r["component_id"]) for r in M.near_duplicates(df).collect()), key=str)
    assert got == want
    return got


def test_documents_match_brute_force(documents):
    got = check(documents)
    assert any(i != c for i, _, c in got)


def test_odd_rows(odd, empty):
    check(odd)
    assert M.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("chunk", [4, 256])
def test_drifting_copies(llm, monkeypatch, chunk):
    """Chains of copies that drift apart: neighbours are linked, ends are not;
    with small chunks buckets go through many cells."""
    monkeypatch.setattr(M, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    rows = []
    for family in range(4):
        words = [f"w{family}x{i}" for i in range(120)]
        for step in range(30):
            for k in rng.integers(0, 120, rng.integers(0, 4)):
                words[k] = f"n{family}x{step}x{k}"
            rows.append((family * 100 + step, " ".join(words)))
    check(llm.createDataFrame(rows, "doc_id long, text string"))


def test_signature_is_circulant():
    """Coordinate k + 1 of a set equals coordinate k of the set shifted by one
    before the second permutation, and the share of equal coordinates of two
    sets is close to their similarity."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = x[:2000], x[1000:]
    first = np.array([0, 2000, 4000])
    s = M.signatures(np.concatenate([a, b]), first, 600)
    spare, out = np.empty(2000, np.uint64), np.empty(2000, np.uint64)
    for k in (0, 1, 599):
        assert s[0, k] == M.pi(M.sigma(a) - np.uint64(k), out, spare).min()
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.06


def test_permutations_are_invertible():
    """Both mixes are products of xor-shifts and odd factors: no two inputs meet."""
    x = np.arange(1 << 18, dtype=np.uint64) * np.uint64(0x10001)
    assert len(np.unique(M.sigma(x))) == len(x)
    assert len(np.unique(M.pi(x, np.empty_like(x), np.empty_like(x)))) == len(x)


def test_a_cell_links_each_component_once():
    """One set against 40 copies of a component: one link says it all, not 40."""
    words = np.arange(100, dtype=np.uint64)
    n = 41
    rows = pa.table({"node": pa.array([b"%02d" % i for i in range(n)]), "key": pa.array([1] * n), "side": pa.array([0] * n), "cell": pa.array([0] * n),
                     "label": pa.array([b"00"] + [b"01"] * 20 + [b"21"] * 20), "left": pa.array([True] + [False] * (n - 1)), "shingles": pa.array([words.tobytes()] * n)})
    links = pa.Table.from_batches(M._judged(rows)).to_pylist()
    assert len(links) == 2
    assert {(r["a"], r["b"] <= b"20") for r in links} == {(b"00", True), (b"00", False)}
