"""Spark session helpers.

Nothing here changes how queries are planned; it only pins the settings the
engine relies on (UTC session clock, AQE, no UI) and resolves the shared
checkpoint folder the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings every session of the engine should have.  Shuffle partitions are a
# starting point only: AQE coalesces small partitions and splits skewed ones.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # only takes effect when this process launches the JVM (local runs, tests)
    "spark.driver.memory": "12g",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "draftspark", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the engine defaults.

    ``master`` is only applied when a new session is built; on a cluster the
    launcher decides it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Resolve the shared checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``; only when that setting
    is absent (unit tests on one machine) do we pick a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = os.path.join("/tmp", f"draftspark-ckpt-{uuid.uuid4().hex[:8]}")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/draftspark/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: a lineage cut that keeps column pruning, pushdown and statistics."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it, for
    sessions that were not started with it on their path or as an archive."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def in_session(spark: SparkSession, fn):
    """Wrap ``fn`` for a driver worker thread: the JVM keeps the active
    session per thread, and plans built without one fail at execution."""
    def run(*args, **kwargs):
        spark._jvm.org.apache.spark.sql.SparkSession.setActiveSession(spark._jsparkSession)
        return fn(*args, **kwargs)
    return run


def session_key(spark: SparkSession) -> tuple:
    """Identity of a live session (application + JVM session id) for caches
    of per-session derived tables."""
    try:
        sid = spark._jsparkSession.sessionUUID()
    except Exception:  # noqa: BLE001 - older JVM sessions without the accessor
        sid = spark._jsparkSession.hashCode()
    return (spark.sparkContext.applicationId, str(sid))
