"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of an edge (a, b) with the smallest node that it
    reaches.  Alternating large-star and small-star steps: each round is two
    aggregations (combined before the shuffle, so a hub is no hot group) and two
    joins that the planner may split; rounds grow with the logarithm of the
    longest path.  Every round is written, so a lost executor costs one round.
    An empty edge table gives an empty result."""
    now = K.written(_oriented(edges), "edges")
    mark = _mark(now)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _oriented(both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = K.written(_oriented(small), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges with a > b."""
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame):
    """Count and two order-free checksums; a fixed point repeats all three."""
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
