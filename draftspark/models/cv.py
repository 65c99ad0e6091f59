"""Grid search over expanding-window folds.

Spark's ``CrossValidator(foldCol)`` trains on every other fold, later ones
included, which leaks the future; here fold ``i`` trains on all matches before its
test window only.  The feature stages are fitted per fold on that fold's training
rows and the transformed folds are written; then all models of all targets, grid
points and folds are fitted by one Spark stage (``fitted.fit_many``).  Grid points
that differ in the number of rounds only are one fit, scored on the way.  The
score is unweighted, and the best grid point (first one on ties) is refitted on
all rows.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import fold_bounds
from ..session import in_session, written
from .fitted import TEST, TRAIN, Task, fit_many, models_of, training_rows
from .grids import growth_of, points


def cv_scores_frame(spark: SparkSession, task: str, grid_points: list[dict], avg, fold_metrics, best: int) -> DataFrame:
    """One row per (task, grid point, fold) with the score, plus the
    mean and a best flag; a handful of rows, built from fit results."""
    rows = []
    for mi, point in enumerate(grid_points or [{}]):
        params = ", ".join(f"{k}={v}" for k, v in sorted(point.items()))
        for fi, fm in enumerate(fold_metrics):
            rows.append((task, mi, params, fi, float(fm[mi]), float(avg[mi]), mi == best))
    return spark.createDataFrame(rows, "task string, grid_point int, params string, fold int, score double, "
                                       "mean_score double, is_best boolean")


def first_best(values: list[float], larger: bool) -> int:
    """The best value's place, the first one on ties."""
    return max(range(len(values)), key=lambda i: (values[i] if larger else -values[i], -i))


def time_series_search(df: DataFrame, feature_stages, targets: dict[str, str], grid: dict, num_folds: int = 3, ordinal_col: str = "ordinal",
                       weight: str | None = "weight", id_col: str = "gameid", parallelism: int = 4, grids: dict[str, dict] | None = None) -> dict:
    """Grid search for one or more targets (name -> loss) that share their
    feature stages.  ``grids`` has the grid of each target that has one of its own.

    Returns {target: (PipelineModel, avg_metrics, fold_metrics, best_index)};
    the measure is accuracy, or mean absolute error for the squared loss."""
    df = written(df, "search-rows")
    n = df.count()
    o = F.col(ordinal_col)
    labels = list(targets)
    spans = [(lo, hi) for _, lo, hi in fold_bounds(n, num_folds) if lo > 0]
    feats = Pipeline(stages=list(feature_stages))

    def features(i: int):
        lo, hi = spans[i] if i < len(spans) else (n, n)  # the last one: all rows, for the refit
        fitted = feats.fit(df.where(o < lo))
        part = F.when(o < lo, TRAIN).otherwise(TEST)
        rows = training_rows(fitted.transform(df.where(o < hi)), i, id_col, labels, part, weight)
        return fitted, written(rows, "search-fold")

    with ThreadPoolExecutor(max(1, min(parallelism, len(spans) + 1))) as pool:
        folds = list(pool.map(in_session(df.sparkSession, features), range(len(spans) + 1)))
    every = folds[0][1]
    for _, rows in folds[1:]:
        every = every.unionByName(rows)

    grid_points = {t: points((grids or {}).get(t, grid)) for t in labels}
    hows = {(t, i): growth_of(p, targets[t]) for t in labels for i, p in enumerate(grid_points[t])}
    alike: dict = {}  # fits that differ in rounds only
    for (t, i), how in hows.items():
        alike.setdefault((t, replace(how, rounds=0)), []).append(i)
    tasks = [Task(f, labels.index(t), replace(how, rounds=max(hows[t, i].rounds for i in own)), tuple(sorted({hows[t, i].rounds for i in own})))
             for (t, how), own in alike.items() for f in range(len(spans))]
    measured = {}
    for r in (fit_many(every, tasks).where("stage IS NOT NULL").collect() if tasks else []):  # one row a fit and round count
        task = tasks[r["task"]]
        measured[task.fold, task.target, replace(task.how, rounds=r["stage"])] = r["measure"] / max(r["n"], 1)
    summary = {}
    for t in labels:
        per_fold = [[measured[f, labels.index(t), hows[t, i]] for i in range(len(grid_points[t]))] for f in range(len(spans))]
        avg = [sum(m[i] for m in per_fold) / max(len(spans), 1) for i in range(len(grid_points[t]))]
        summary[t] = (avg, per_fold, first_best(avg, targets[t] != "squared"))
    last = [Task(len(spans), labels.index(t), hows[t, summary[t][2]], keep=True) for t in labels]
    refitted = models_of(fit_many(folds[-1][1], last), last)
    return {t: (PipelineModel(stages=[*folds[-1][0].stages, model]), *summary[t]) for t, model in zip(labels, refitted, strict=True)}


class _SearchParams(Params):
    labelCol = Param(Params._dummy(), "labelCol", "target", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "row weight; empty: none", TypeConverters.toString)
    ordinalCol = Param(Params._dummy(), "ordinalCol", "place in time, from 0", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "row key", TypeConverters.toString)
    loss = Param(Params._dummy(), "loss", "logistic or squared", TypeConverters.toString)
    folds = Param(Params._dummy(), "folds", "expanding windows", TypeConverters.toInt)
    grid = Param(Params._dummy(), "grid", "parameter grid as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(labelCol="result", weightCol="weight", ordinalCol="ordinal", idCol="gameid", loss="logistic", folds=3,
                         grid=json.dumps({"n_estimators": [100]}))

    def _p(self, name):
        return self.getOrDefault(getattr(self, name))


class TimeSeriesSearch(Estimator, _SearchParams, MLWritable, MLReadable):
    """M9 as an Estimator: fit searches the grid over expanding windows and
    returns the refitted best pipeline with its scores.  Copies, saves and loads
    with its feature stages, and can be a stage of a ``Pipeline``."""

    def __init__(self, stages=(), **kw):
        super().__init__()
        self.stages = list(stages)
        self._set(**{k: json.dumps(v) if k == "grid" and not isinstance(v, str) else v for k, v in kw.items()})

    def copy(self, extra=None):
        other = super().copy(extra)
        other.stages = [s.copy(extra) for s in self.stages]
        return other

    def _fit(self, df: DataFrame) -> TimeSeriesSearchModel:
        t, grid = self._p("labelCol"), json.loads(self._p("grid"))
        found = time_series_search(df, self.stages, {t: self._p("loss")}, grid, self._p("folds"), self._p("ordinalCol"), self._p("weightCol") or None, self._p("idCol"))
        model, avg, per_fold, best = found[t]
        out = TimeSeriesSearchModel(model, avg, per_fold, best)
        self._copyValues(out)
        return out

    def write(self) -> MLWriter:
        return _Writer(self, Pipeline(stages=self.stages), {})

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(lambda inner, extra: cls(inner.getStages()), Pipeline)


class TimeSeriesSearchModel(Model, _SearchParams, MLWritable, MLReadable):
    def __init__(self, best_model: PipelineModel, avg_metrics, fold_metrics, best_index: int):
        super().__init__()
        self.bestModel, self.avgMetrics, self.foldMetrics, self.bestIndex = best_model, avg_metrics, fold_metrics, best_index

    def scores(self, spark: SparkSession, task: str) -> DataFrame:
        return cv_scores_frame(spark, task, points(json.loads(self._p("grid"))), self.avgMetrics, self.foldMetrics, self.bestIndex)

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.bestModel.transform(df)

    def write(self) -> MLWriter:
        return _Writer(self, self.bestModel, {"avg": self.avgMetrics, "folds": self.foldMetrics, "best": self.bestIndex})

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(lambda inner, extra: cls(inner, extra["avg"], extra["folds"], extra["best"]), PipelineModel)


class _Writer(MLWriter):
    """Params as metadata, the inner pipeline beside them."""

    def __init__(self, instance, inner, extra: dict):
        super().__init__()
        self.instance, self.inner, self.extra = instance, inner, extra

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession.sparkContext, extraMetadata={"extra": self.extra})
        self.inner.write().overwrite().save(f"{path}/inner")


class _Reader(MLReader):
    def __init__(self, make, inner):
        super().__init__()
        self.make, self.inner = make, inner

    def load(self, path: str):
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession.sparkContext)
        out = self.make(self.inner.load(f"{path}/inner"), meta["extra"])
        out._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(out, meta)
        return out
