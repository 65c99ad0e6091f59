import random

import numpy as np
import pytest
import zstandard

from draftspark.llm import repeats as M


def brute(rows, length=50):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            if i is not None:
                w = b[k:k + length]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if i is not None and least[b[k:k + length]] < i:
                gone[k:k + length] = b"\1" * length
        edges = [k for k in range(len(b) + 1) if (k < len(b) and gone[k]) != (k > 0 and gone[k - 1])]
        out.append((i, len(b), list(zip(edges[::2], edges[1::2])), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def run(df):
    return sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in M.remove_repeats(df).collect()), key=str)


def test_documents_match_brute_force(documents):
    rows = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
    assert run(documents) == brute(rows)


def test_odd_rows(odd, empty):
    rows = [(r[0], r[1] if len(r[1] or "") < 10_000 else r[1]) for r in odd.select("doc_id", "text").collect()]
    assert run(odd) == brute(rows)
    assert run(empty) == []


@pytest.mark.parametrize("seed", range(3))
def test_overlapping_repeats(llm, monkeypatch, seed):
    """Few letters, long runs and nested repeats, over many blocks and shards."""
    monkeypatch.setattr(M, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(M, "SHARD_BYTES", 3000)
    rnd = random.Random(seed)
    passages = ["".join(rnd.choices("ab ", k=rnd.randrange(30, 200))) for _ in range(12)] + ["a" * 120, "ab" * 60]
    rows = []
    for i in range(60):
        parts = [rnd.choice(passages)[rnd.randrange(0, 20):rnd.randrange(20, 220)] if rnd.random() < 0.6 else "".join(rnd.choices("abcdé\n", k=rnd.randrange(0, 80))) for _ in range(rnd.randrange(0, 6))]
        rows.append((rnd.randrange(0, 50), "".join(parts)))
    assert run(llm.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_stack_scan_names_the_maximal_repeats():
    text = np.frombuffer(b"xabcdyabcdzabce" + bytes(32), np.uint8).copy()
    at = np.arange(15)
    order, common = M.suffix_order(text, at, 15 - at, 15)
    before = np.where(at > 0, text[at - 1].astype(np.int64), -1)[order]
    found = {text[order[a]:order[a] + n].tobytes(): sorted(order[a:b].tolist()) for n, a, b in M.maximal_repeats(common, before, 3)}
    assert found == {b"abcd": [1, 6], b"abc": [1, 6, 11]}


def test_a_packet_names_its_own_documents_only():
    """A block sends a packet to every shard, so what all of them hold would grow with the square of the input."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 123, 200).astype(np.uint8) for _ in range(300)]
    offsets = np.arange(301) * 200
    data = np.concatenate([*texts, np.zeros(32, np.uint8)])
    start, place = M.window_strings(data, offsets, M.LENGTH)
    row = {"doc_ids": list(range(1000, 1300)), "offsets": offsets.astype(np.int64).tobytes(), "data": zstandard.ZstdCompressor(3).compress(data[:60_000].tobytes()),
           "strings": M._packed(np.diff(start, prepend=0).astype(np.uint32), place.astype(np.uint8))}
    block = M.Block(row, M.LENGTH, 500)
    block.keep([{"shard": k, "bits": b"\xff" * 200} for k in range(500)])
    for _, a, b in block.shards():
        ids, size, _, low, more, raw = M._unpacked(block.packet(a, b), np.int64, np.uint8, np.uint8, np.uint32, np.uint32, np.uint8)
        assert len(ids) <= 2 * (b - a) and len(raw) == size.sum()
        assert np.array_equal(np.cumsum(ids)[low + more], block.sorted_ids[block.high[a:b]])
