import re

from draftspark.llm import decontam as M

from .conftest import SF


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, size=10):
    windows = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(str(item) if item is not None else "")
    out = []
    for i, t in docs:
        w, hit, named = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    named |= windows[tuple(w[k:k + n])]
        out.append((i, len(w), len(hit), sorted(named)))
    return sorted(out, key=str)


def run(docs, items):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in M.contamination(docs, items).collect()), key=str)


def test_documents_match_brute_force(llm, documents):
    items = llm.read.parquet(f"{SF}/benchmark.parquet")
    docs = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
    want = brute(docs, [tuple(r) for r in items.select("item_id", "text").collect()])
    assert any(r[2] for r in want)
    assert run(documents, items) == want


def test_several_blocks_and_odd_rows(llm, odd, empty, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_WINDOWS", 2)
    items = llm.createDataFrame([(1, "same long LINE of"), (2, "forty characters"), (2, "forty characters"), (None, "hello, world"), (3, None), (4, ""),
                                 (5, "word1 of a very long text word2 of a very long text word3"), (6, "the the"), (7, "日本語")], "item_id long, text string")
    docs = [(r[0], r[1]) for r in odd.select("doc_id", "text").collect()]
    assert run(odd, items) == brute(docs, [tuple(r) for r in items.collect()])
    assert run(empty, items) == []
    assert all(n == 0 for _, _, n, _ in run(odd, items.limit(0)))
    kept = {r["doc_id"] for r in M.drop_contaminated(odd, items.where("item_id = 2")).collect()}
    assert kept == {2, 3, 4, None, 8, 9, 10, 12, 13}


def test_many_blocks_in_several_passes(llm, documents, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_WINDOWS", 100)
    monkeypatch.setattr(M, "PASS_BLOCKS", 2)
    items = llm.read.parquet(f"{SF}/benchmark.parquet")
    passes = []
    write = M.K.written
    monkeypatch.setattr(M.K, "written", lambda df, name: passes.append(name) or write(df, name))
    docs = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
    assert run(documents, items) == brute(docs, [tuple(r) for r in items.select("item_id", "text").collect()])
    assert passes.count("marks") > 1


def test_proximity(llm):
    docs = llm.createDataFrame([(1, "alpha one two beta"), (2, "alpha one two three four beta"), (3, "beta x alpha"), (4, "alpha"), (5, "beta")], "doc_id long, text string")
    from pyspark.sql import functions as F

    phrases = M.test_windows(llm.createDataFrame([(1, "alpha beta")], "item_id long, text string")).withColumn("window_id", F.xxhash64("window"))
    found = M.search(M.build_index(docs), phrases.select("window_id", "window"), slop=3)
    assert sorted(r["doc_id"] for r in found.where("n_hit > 0").collect()) == [1, 3]


def test_clean_texts_are_not_shuffled(llm, documents):
    kept = M.drop_contaminated(documents, llm.read.parquet(f"{SF}/benchmark.parquet"))
    assert "hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
