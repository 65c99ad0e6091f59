import corpus_pipeline
from draftspark.llm import decontam, langid, line_dedup, simhash

from .conftest import SF
from .test_decontam import brute as brute_items
from .test_line_dedup import brute as brute_lines
from .test_simhash import brute_print, classes


def test_stages_and_registration():
    import __spark_entry__ as entry

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece_encoding"]
    names = set(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert all(m for m in (decontam, langid, line_dedup, simhash))


def test_each_stage_matches_brute_force(llm, documents):
    docs = documents
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)

    docs = corpus_pipeline.written(steps["language_id"](llm, docs, SF), "t")
    assert docs.columns == corpus_pipeline.COLUMNS
    assert {r["doc_id"] for r in docs.collect()} == {i for i, t in rows.items() if any(c.isalpha() for c in t or "")}

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    docs = corpus_pipeline.written(steps["line_dedup"](llm, docs, SF), "t")
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect()) == sorted((i, t, len(t)) for i, t, _, _ in brute_lines(rows))

    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    docs = corpus_pipeline.written(steps["simhash_near_dedup"](llm, docs, SF), "t")
    label = classes([brute_print(t) for _, t in rows], 3)
    firsts = {c: i for (i, _), c in reversed(list(zip(rows, label)))}
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(firsts.values())

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in llm.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = corpus_pipeline.written(steps["benchmark_decontamination"](llm, docs, SF), "t")
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(i for i, _, hit, _ in brute_items(rows, items) if not hit)

    out = steps["sentencepiece_encoding"](llm, docs, SF)
    assert out.count() == docs.count() and out.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids"]
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(llm, SF).select("doc_id").collect()) == sorted(r["doc_id"] for r in docs.collect())


def test_stages_take_odd_and_empty_tables(llm, odd, empty):
    for df in (odd, empty):
        docs = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.written(stage(llm, docs, SF), "t")
            assert docs.columns == corpus_pipeline.COLUMNS
        assert corpus_pipeline.STAGES[-1][1](llm, docs, SF).count() == docs.count()
