"""Model registry.

Fitted pipelines are saved with Spark ML persistence under one base folder
(``<base>/<task>/<target>``) with a manifest table (task, target, threshold,
path, status).  Loading reads the manifest and loads each model, recording a
failure instead of stopping (the reference skips models that fail to load).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.decisions import parse_threshold
from .train import TrainResult

MANIFEST_SCHEMA = "task string, target string, threshold double, path string, status string"

# The single-model tasks the scorer expects, and the threshold tasks.
EXPECTED_TASKS = ["match_winner", "ultimate_winner", "game_length", "total_kills", "total_towers",
                  "kill_thresholds", "time_thresholds", "tower_thresholds"]


def save_registry(spark: SparkSession, results: list[TrainResult], base: str) -> DataFrame:
    rows = []
    for r in results:
        path = f"{base.rstrip('/')}/{r.task}/{r.target}"
        status = r.status
        if r.model is not None and r.status == "ok":
            try:
                r.model.write().overwrite().save(path)
            except Exception as e:  # noqa: BLE001 - recorded in the manifest
                status = f"save_failed: {type(e).__name__}: {e}"
        rows.append((r.task, r.target, r.threshold, path, status))
    return write_manifest(spark, rows, base)


def write_manifest(spark: SparkSession, rows: list[tuple], base: str) -> DataFrame:
    """The manifest of a base folder: one row a model (``MANIFEST_SCHEMA``)."""
    manifest = spark.createDataFrame(rows, MANIFEST_SCHEMA)
    manifest.write.mode("overwrite").parquet(f"{base.rstrip('/')}/_manifest")
    return manifest


def read_manifest(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/_manifest")


def saved_thresholds(manifest: DataFrame) -> DataFrame:
    """The threshold of each saved model, read from its path, and its
    place among those of its task by that number.  A manifest has one row a
    model, so a task's window is a few rows."""
    found = manifest.select("task", "path", parse_threshold("path").alias("threshold")).where("threshold IS NOT NULL")
    order = Window.partitionBy("task").orderBy("threshold", "path")
    return found.withColumn("position", F.row_number().over(order))


class Registry:
    """Loaded models keyed by (task, target) -> (model, threshold), plus the
    manifest with each model's load status."""

    def __init__(self, models: dict, manifest: DataFrame):
        self.models = models
        self.manifest = manifest

    def get(self, task: str, target: str | None = None):
        for (t, tg), (m, _) in self.models.items():
            if t == task and (target is None or tg == target):
                return m
        return None

    def thresholds(self, task: str) -> list[tuple[str, float, object]]:
        return sorted(((tg, th, m) for (t, tg), (m, th) in self.models.items() if t == task),
                      key=lambda x: x[1])

    def errors(self) -> dict[str, str]:
        """task -> first non-ok status (small: one row per model)."""
        out = {}
        for r in self.manifest.where("status <> 'ok'").collect():
            out.setdefault(r["task"], r["status"])
        return out


def load_registry(spark: SparkSession, base: str) -> Registry:
    manifest = read_manifest(spark, base)
    models, status = {}, []
    for r in manifest.collect():  # one row per model: a few dozen rows
        st = r["status"]
        if st == "ok":
            try:
                models[(r["task"], r["target"])] = (PipelineModel.load(r["path"]), r["threshold"])
            except Exception as e:  # noqa: BLE001 - skip models that fail to load
                st = f"load_failed: {type(e).__name__}: {e}"
        status.append((r["task"], r["target"], r["threshold"], r["path"], st))
    return Registry(models, spark.createDataFrame(status, MANIFEST_SCHEMA))


def registry_from_results(spark: SparkSession, results: list[TrainResult]) -> Registry:
    """In-memory registry (no save/load round trip)."""
    models = {(r.task, r.target): (r.model, r.threshold) for r in results if r.model is not None}
    rows = [(r.task, r.target, r.threshold, "", r.status) for r in results]
    return Registry(models, spark.createDataFrame(rows, MANIFEST_SCHEMA))


def registry_check(manifest: DataFrame, expected=EXPECTED_TASKS) -> DataFrame:
    """Expected tasks against the manifest: models loaded and missing."""
    spark = manifest.sparkSession
    exp = spark.createDataFrame([(t,) for t in expected], "task string")
    got = manifest.groupBy("task").agg(
        F.sum(F.when(F.col("status") == "ok", 1).otherwise(0)).alias("ok_models"),
        F.count(F.lit(1)).alias("models"))
    return (exp.join(got, "task", "left")
            .select("task", F.coalesce("ok_models", F.lit(0)).alias("ok_models"),
                    F.coalesce("models", F.lit(0)).alias("models"),
                    (F.coalesce("ok_models", F.lit(0)) == 0).alias("missing")))
