"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark
decontamination, SentencePiece encoding.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame.  All but the last return the columns of ``documents``
(doc_id, text, lang, source, n_chars) and work on all rows that their
predecessor kept; columns of other names that ``docs`` may have are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftspark.llm.decontam import drop_contaminated
from draftspark.llm.langid import drop_unidentified
from draftspark.llm.line_dedup import dedup_lines
from draftspark.llm.pieces import encode
from draftspark.llm.registry import reachable, table
from draftspark.llm.simhash import keep_one
from draftspark.llm.textkit import written
from draftspark.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _start(spark: SparkSession, docs: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(spark)
    reachable(spark)
    return docs.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go; a missing lang is filled in."""
    return drop_unidentified(_start(spark, docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, but for the last document that holds one."""
    out = dedup_lines(_start(spark, docs))
    return out.select("doc_id", "text", "row.lang", "row.source", F.char_length("text").cast("long").alias("n_chars"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays."""
    return keep_one(_start(spark, docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a ten-word window of a benchmark item go."""
    return drop_contaminated(_start(spark, docs), table(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens and the piece numbers."""
    out = encode(_start(spark, docs))
    return out.select("row.doc_id", "row.lang", "row.source", "row.n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: Trained filters, fingerprints and segmentation have no SQL; tests compare the
#: stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    ensure_checkpoint_dir(spark)
    reachable(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
