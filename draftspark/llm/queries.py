"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import circulant
from .decontam import contamination
from .filter_audit import audit, failures
from .fim import fill_in_middle, restore
from .langid import identify
from .line_dedup import dedup_lines
from .repeats import remove_repeats
from .simhash import near_duplicates
from .vptree import nearest
from .main_text import extract
from .pii import KINDS, find
from .paragraphs import dedup_paragraphs
from .pieces import decode, encode
from .registry import ORACLE, QUERIES, register, table  # noqa: F401


OP9_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT rid, doc_id, pos, line,
             translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key),
m AS (SELECT k.rid, k.pos, k.line, coalesce(s.n >= 5 AND k.doc_id IS DISTINCT FROM s.last, false) AS gone
      FROM k LEFT JOIN s ON k.key = s.key)
SELECT d.doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m JOIN d USING (rid) GROUP BY d.rid, d.doc_id
"""


@register("op9_line_dedup", OP9_SQL)
def op9(spark, sf):
    out = dedup_lines(table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_ITEM_WINDOWS = """
w AS (SELECT item_id, CASE WHEN len(ws) <= 10 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 8), lambda i: array_to_string(ws[i:i+9], ' ')) END AS wins, least(len(ws), 10) AS wl
      FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark) WHERE len(ws) > 0),
iw AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, wl, unnest(wins) AS win FROM w)"""

OP8_SQL = f"""
WITH {_ITEM_WINDOWS.strip()},
d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
lens AS (SELECT DISTINCT wl FROM iw),
dw AS (SELECT rid, wl, i, array_to_string(ws[i:i+wl-1], ' ') AS win
       FROM (SELECT rid, ws, wl, unnest(range(1, len(ws) - wl + 2)) AS i FROM d, lens WHERE len(ws) >= wl)),
h AS (SELECT dw.rid, dw.wl, dw.i, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.wl = iw.wl),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + wl)) AS p FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
      FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)
"""


@register("op8_decontamination", OP8_SQL)
def op8(spark, sf):
    out = contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@register("op6_simhash_near_dedup")
def op6(spark, sf):
    out = near_duplicates(table(spark, sf, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op2_language_id")
def op2(spark, sf):
    out = identify(table(spark, sf, "documents"))
    return out.select("row.doc_id", "held_out", "lang_pred", "score")


@register("op3_sentencepiece")
def op3(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("source"))
    return decode(encode(docs)).select("row.row.doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"),
                                       F.sha2("text", 256).alias("decoded_sha256"), (F.sha2("text", 256) == F.col("row.row.source")).alias("round_trip"))


@register("op1_pii")
def op1(spark, sf):
    """n_<kind> count the base spans; n_added those that only the transducers found."""
    out = find(table(spark, sf, "documents"))
    spans = F.array_sort(F.transform("spans", lambda s: F.struct(_kind(s).alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"))))

    def joined(some):
        return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return out.withColumn("spans", spans).select(
        "row.doc_id", *map(count, KINDS), F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))


def _kind(span):
    return F.array_position(F.array(*map(F.lit, KINDS)), span["kind"]).cast("int")


@register("op4_html_extraction")
def op4(spark, sf):
    out = extract(table(spark, sf, "pages"))
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


@register("op7_nearest_neighbours")
def op7(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


@register("op10_substring_dedup")
def op10(spark, sf):
    out = remove_repeats(table(spark, sf, "documents"))
    return out.select("doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@register("op5_paragraph_dedup")
def op5(spark, sf):
    """One row per document: what it loses and to which documents' classes."""
    out = dedup_paragraphs(table(spark, sf, "documents"))
    return out.select("doc_id", "n_paragraphs", "n_removed", F.col("classes").alias("duplicate_of"), F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = """
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS us,
             CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:n], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


@register("op11_fill_in_middle", OP11_SQL)
def op11(spark, sf):
    out = restore(fill_in_middle(table(spark, sf, "documents").select("doc_id", "text")))
    return out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH RECURSIVE d AS (
SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS shingle FROM d),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS both FROM s a JOIN s b ON a.shingle = b.shingle AND a.rid <> b.rid GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.rid = p.a JOIN n y ON y.rid = p.b WHERE 100 * p.both >= 85 * (x.n + y.n - p.both)),
r(rid, node) AS (SELECT rid, rid FROM d UNION SELECT r.rid, e.b FROM r JOIN e ON e.a = r.node),
c AS (SELECT r.rid, min(o.doc_id) AS component_id FROM r JOIN d o ON o.rid = r.node GROUP BY r.rid)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(d.doc_id = c.component_id, c.component_id IS NULL) AS kept
FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)
"""


@register("op12_minhash_near_dedup", OP12_SQL)
def op12(spark, sf):
    out = circulant.near_duplicates(table(spark, sf, "documents"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP13_SQL = r"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS low FROM t),
f AS (SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
        CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
      + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > low THEN 16 ELSE 0 END AS fails
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
k AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
b(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.f || b2.f || c.f || d.f || e.f AS filter_order, [a.bit, b2.bit, c.bit, d.bit, e.bit] AS bits
      FROM b a, b b2, b c, b d, b e WHERE a.bit + b2.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b2.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, CAST(i AS INT) AS step, bits[i] AS bit, CAST(coalesce(list_sum(bits[1:i-1]), 0) AS INT) AS before FROM o, range(1, 6) r(i)),
x AS (SELECT k.part, filter_order, step, bit,
        coalesce(sum(n) FILTER (WHERE fails & (before | bit) = 0), 0) AS kept,
        coalesce(sum(n) FILTER (WHERE fails & bit <> 0 AND fails & before = 0), 0) AS removed,
        coalesce(sum(n) FILTER (WHERE fails & bit <> 0 AND fails & before <> 0), 0) AS redundant,
        coalesce(sum(n) FILTER (WHERE fails = bit), 0) AS unique_fails,
        coalesce(sum(n) FILTER (WHERE fails & bit <> 0 AND fails & before = 0 AND good = 1), 0) AS good_lost,
        coalesce(sum(n) FILTER (WHERE fails & bit <> 0 AND fails & before = 0 AND toxic = 1), 0) AS toxic_lost
      FROM k, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM x
"""


@register("op13_filter_audit", OP13_SQL)
def op13(spark, sf):
    return audit(failures(table(spark, sf, "documents").select("doc_id", "text", "source"), table(spark, sf, "labels")))
