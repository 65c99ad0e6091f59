from pyspark.sql import functions as F

from draftspark.llm import langid as M


def test_held_out_accuracy(documents):
    found = M.identify(documents)
    right = found.where("held_out").agg(F.avg((F.col("row.lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert right[0] >= 0.95 and 0 <= right[1] and right[2] <= 1
    assert found.count() == documents.count()
    import zlib

    for r in found.select("row.doc_id", "held_out").collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_labels_of_held_out_rows_and_other_columns_are_not_used(documents):
    other = documents.withColumn("lang", F.when(M.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a = {r[0]: (r[1], r[2]) for r in M.identify(documents).select("row.doc_id", "lang_pred", "score").collect()}
    b = {r[0]: (r[1], r[2]) for r in M.identify(other).select("row.doc_id", "lang_pred", "score").collect()}
    assert a == b


def test_odd_rows(odd, empty, llm):
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in M.identify(odd, keep_text=True).select("row.doc_id", "text", "lang_pred", "score").collect()}
    assert got[(2, None)] == got[(3, "")] == got[(8, "   \n\t ")] == ("und", 0.0)
    assert all(lang == "en" for (_, t), (lang, _) in got.items() if t and t.strip())
    assert M.identify(empty).count() == 0
    none = M.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert {r["doc_id"] for r in M.drop_unidentified(odd).collect()} == {1, 4, 5, 6, None, 7, 9, 10, 11, 12, 13}


def test_bit_slices_claim_every_trained_ngram():
    import numpy as np
    import pyarrow as pa

    words = M.Words(pa.array(["Der Hund", "the dog", "", None, "12"]))
    assert words.letters.tolist() == [7, 6, 0, 0, 0]
    size, gram = 1 << 12, words.gram
    table = np.zeros((size, 2), np.uint64)
    for k in range(M.HASHES):
        np.bitwise_or.at(table[:, 1], M.slot_of(gram, k, size), np.uint64(4))
    assert (M.Filters([f"l{i}" for i in range(67)], table).languages(gram)[:, 1] & np.uint64(4) != 0).all()
