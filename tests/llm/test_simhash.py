import re

import numpy as np
import pytest
import xxhash

from draftspark.llm import simhash as M


def brute_print(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[k:k + width]) for k in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(prints, bits):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def check(df):
    rows = [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]
    prints = [brute_print(t) for _, t in rows]
    label = classes(prints, 3)
    low = {}
    for (i, _), c in zip(rows, label, strict=True):
        low[c] = min([x for x in (low.get(c), i) if x is not None], default=None)
    want = sorted(((i, p, low[c]) for (i, _), p, c in zip(rows, prints, label, strict=True)), key=str)
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in M.near_duplicates(df).collect()), key=str)
    assert got == want
    return len(set(label))


def test_documents_match_brute_force(documents):
    check(documents)


def test_odd_rows(odd, empty):
    n = check(odd)
    kept = M.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == n
    assert M.near_duplicates(empty).count() == 0 and M.keep_one(empty).count() == 0


@pytest.mark.parametrize("limit", [4, 1000])
def test_links_lose_nothing(llm, monkeypatch, limit):
    """Random clusters, dense and loose, with buckets dealt out again."""
    monkeypatch.setattr(M, "BUCKET", limit)
    rng = np.random.default_rng(5)
    prints = set()
    for _ in range(30):
        center = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(20):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            prints.add(center ^ sum(1 << int(f) for f in flips))
    prints = sorted(prints)
    df = llm.createDataFrame([(M._long(p),) for p in prints], "fp long")
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in M.links(df).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in links)
    at, label = {p: i for i, p in enumerate(prints)}, list(range(len(prints)))
    for a, b in links:
        x, y = label[at[a]], label[at[b]]
        label = [min(x, y) if v == max(x, y) else v for v in label]
    assert label == classes(prints, 3)


def test_gray_rank_neighbours_differ_in_one_bit():
    rank = M.gray_rank(np.arange(256, dtype=np.uint64))
    by_rank = np.argsort(rank)
    assert sorted(rank.tolist()) == list(range(256))
    assert (np.bitwise_count(by_rank[1:] ^ by_rank[:-1]) == 1).all()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kept_texts_are_not_shuffled(llm):
    """Copies to drop are few and of known size: the texts stay where they are."""
    rows = [(i, f"text {i} has words of its own, {i * 7} and {i * 13}, and some more {i * 31}") for i in range(50)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    kept = M.keep_one(llm.createDataFrame(rows, "doc_id long, text string"))
    assert "hashpartitioning" not in plan(kept)
    assert not {r["doc_id"] for r in kept.collect()} & set(range(100, 105))
