import numpy as np

from draftspark.llm import line_dedup as M


def brute(rows, least=40, docs=5):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)

    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).update([i] if i is not None else [])
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and len(holders[key(x)]) >= docs and i != max(holders[key(x)]))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str)


def test_documents_match_brute_force(documents):
    rows = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
    assert rows_of(M.dedup_lines(documents)) == sorted(brute(rows), key=str)


def test_odd_rows(odd, empty):
    rows = [(r[0], r[1]) for r in odd.select("doc_id", "text").collect()]
    out = M.dedup_lines(odd)
    assert rows_of(out) == sorted(brute(rows), key=str)
    assert [f.name for f in out.schema["row"].dataType][:1] == ["lang"] and "shard" in out.schema["row"].dataType.names
    assert M.dedup_lines(empty).count() == 0


def test_hot_line_is_dealt_out(llm, monkeypatch):
    monkeypatch.setattr(M, "TASK_PROBES", 10)
    line = "x" * 50
    df = llm.createDataFrame([(i, line if i % 3 else f"{i} " + line) for i in range(200)], "doc_id long, text string")
    assert rows_of(M.dedup_lines(df)) == sorted(brute([(r[0], r[1]) for r in df.collect()]), key=str)


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.int64)).astype(np.uint64)
    sizes, bits = M.mph_build(keys)
    assert sorted(M.mph_rank(sizes, bits, keys).tolist()) == list(range(len(keys)))
