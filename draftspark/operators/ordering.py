"""Chronological order, weights, folds and splits.

The global ordinal never uses an unpartitioned window: rows are range
partitioned on the (total) sort key, sorted inside each partition, written to
the shared checkpoint folder (so range bounds and row ids are fixed even if
executors are lost), counted per partition, and numbered with per-partition
offsets.  Only one count per partition reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import token_hash
from ..session import ensure_checkpoint_dir


def _n_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def global_ordinal(df: DataFrame, order_cols: list, name: str = "ordinal",
                   num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based ordinal following ``order_cols`` (must be a total order)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or _n_partitions(df)
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ranged = (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    counts = sorted((r["_pid"], r["count"]) for r in ranged.groupBy("_pid").count().collect())
    offsets, acc = [], 0
    for pid, c in counts:
        offsets.append((pid, acc))
        acc += c
    off = spark.createDataFrame(offsets or [(0, 0)], "_pid int, _off bigint")
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (ranged.join(F.broadcast(off), "_pid")  # one row per partition
            .withColumn(name, F.col("_off") + local)
            .drop("_pid", "_mid", "_off"))


def match_order_key() -> list[Column]:
    """Total order of matches: date, then numeric game id (Q1)."""
    return [F.col("date"), F.col("gameid").cast("bigint"), F.col("gameid")]


def with_ordinal(matches: DataFrame, name: str = "ordinal") -> DataFrame:
    return global_ordinal(matches, match_order_key(), name)


def recency_weight(ordered: DataFrame, n: int, start: float, stop: float,
                   ordinal: str = "ordinal", name: str = "weight") -> DataFrame:
    """``linspace(start, stop, n)`` aligned with the ordinal; n = 1 -> start."""
    if n <= 1:
        w = F.lit(float(start))
    else:
        w = F.lit(float(start)) + F.lit(float(stop - start)) * F.col(ordinal) / F.lit(float(n - 1))
    return ordered.withColumn(name, w)


def fold_bounds(n: int, k: int) -> list[tuple[int, int, int]]:
    """Expanding-window folds: (fold, test_start, test_end); train = [0, test_start)."""
    t = n // (k + 1)
    return [(i, n - (k - i) * t, n - (k - i - 1) * t) for i in range(k)]


def time_folds(ordered: DataFrame, n: int, k: int, ordinal: str = "ordinal") -> DataFrame:
    """Long form (fold, role, row) of expanding-window folds.  Each row
    goes to the folds where it trains or tests (narrow: one explode)."""
    t = n // (k + 1)
    o = F.col(ordinal)
    entries = []
    for i in range(k):
        lo, hi = n - (k - i) * t, n - (k - i - 1) * t
        role = F.when(o < lo, F.lit("train")).when(o < hi, F.lit("test"))
        entries.append(F.struct(F.lit(i).alias("fold"), role.alias("role")))
    tagged = ordered.withColumn("_f", F.explode(F.filter(F.array(*entries), lambda e: e["role"].isNotNull())))
    return tagged.withColumn("fold", F.col("_f.fold")).withColumn("role", F.col("_f.role")).drop("_f")


def tail_split(ordered: DataFrame, n: int, test_size: float = 0.2, ordinal: str = "ordinal",
               name: str = "split") -> DataFrame:
    """Chronological split; the test part has ``ceil(test_size * n)`` rows."""
    import math
    n_test = math.ceil(test_size * n)
    return ordered.withColumn(
        name, F.when(F.col(ordinal) < F.lit(n - n_test), F.lit("train")).otherwise(F.lit("test")))


def hash_split(df: DataFrame, key: str, seed: int = 42, train_pct: int = 80,
               name: str = "split") -> DataFrame:
    """Random split that is stable across partitions and reruns: bucket
    of the hashed key (salted by the seed)."""
    h = token_hash(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")))
    return df.withColumn(name, F.when(h % 100 < train_pct, F.lit("train")).otherwise(F.lit("test")))


def stratified_folds(df: DataFrame, key: str, label: str, k: int, seed: int = 42,
                     name: str = "fold") -> DataFrame:
    """Shuffled stratified k-fold.  Rows are put in a seeded hash order
    inside each label; the ordinal inside the label modulo k is the fold.
    The per-label ordinal comes from the global ordinal minus the label's
    start, so no window holds a whole label."""
    h = token_hash(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")))
    keyed = df.withColumn("_h", h)
    ordered = global_ordinal(keyed, [F.col(label), F.col("_h"), F.col(key)], "_g")
    starts = ordered.groupBy(label).agg(F.min("_g").alias("_s"))  # one row per label value
    return (ordered.join(starts, label)
            .withColumn(name, ((F.col("_g") - F.col("_s")) % k).cast("int"))
            .drop("_h", "_g", "_s"))
