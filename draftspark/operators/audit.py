"""Data-quality audits and name lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import ALIASES, KNOWN_PROBLEM_NAMES, normalize_name, search_key, strip_id


def name_audit(names: DataFrame, col: str = "name") -> DataFrame:
    """Each distinct name, its title-cased form, whether they differ,
    and whether it contains an apostrophe."""
    d = names.select(F.col(col).alias("name")).where(F.col("name").isNotNull()).distinct()
    t = normalize_name("name")
    return d.select("name", t.alias("titled"), (F.col("name") != t).alias("changed"),
                    F.col("name").contains("'").alias("has_apostrophe"))


def name_presence(names: DataFrame, known=KNOWN_PROBLEM_NAMES, col: str = "name") -> DataFrame:
    """For a known-name list, present in the data or not (left join
    from the list, which is fixed and small)."""
    spark = names.sparkSession
    k = spark.createDataFrame([(n,) for n in known], "name string")
    seen = names.select(F.col(col).alias("name")).distinct().withColumn("_hit", F.lit(True))
    out = k.join(seen, "name", "left")
    return out.select("name", F.coalesce("_hit", F.lit(False)).alias("present"),
                      normalize_name("name").alias("titled"),
                      (normalize_name("name") == F.col("name")).alias("titled_equal"))


def champion_search(names: DataFrame, query: str, col: str = "name") -> DataFrame:
    """names whose search key contains the query's search key."""
    q = "".join(ch for ch in query.lower() if ch.isascii() and ch.isalnum())
    return names.where(search_key(col).contains(F.lit(q)))


def substring_search(names: DataFrame, needle: str, col: str = "name") -> DataFrame:
    """case-insensitive substring test."""
    return names.where(F.lower(F.col(col)).contains(F.lit(needle.lower())))


def canonical_id(names: DataFrame, col: str = "name") -> DataFrame:
    """alias table (fixed, eleven rows, broadcast) else strip ``' .``."""
    spark = names.sparkSession
    a = spark.createDataFrame(list(ALIASES.items()), "alias_name string, alias_id string")
    out = names.join(F.broadcast(a), F.col(col) == F.col("alias_name"), "left")
    return out.withColumn("canonical_id", F.coalesce("alias_id", strip_id(col))).drop("alias_name", "alias_id")
