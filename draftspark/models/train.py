"""Model training tasks.

Every task starts from a reconstructed match table, adds the chronological
ordinal and recency weights where the reference weights samples, and fits
pipelines whose feature stages are the engine's encoders, so each CV fold refits
them on its own training rows; the learners are those of ``fitted``.

Grids: a task searches its grid of ``grids.REFERENCE_GRIDS`` unless it is
given another (tests pass smaller ones; registered queries do not).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import token_hash
from ..operators.encoders import TeamStrengthEncoder, TeamTargetEncoder
from ..operators.evaluate import regression_metrics
from ..operators.labels import kill_labels, minute_labels, over_labels_wide, turret_labels
from ..operators.ordering import (global_ordinal, hash_split, recency_weight, stratified_folds, tail_split,
                                  with_ordinal)
from ..operators.vectors import PickHasher
from ..session import in_session, written
from .cv import cv_scores_frame, first_best, time_series_search
from .ensemble import MEMBERS, average, settings_of
from .fitted import TEST, TRAIN, VALID, Task, fit_many, models_of, training_rows
from .grids import REFERENCE_GRIDS, points
from .kernel import Machine
from .stages import encoded_features, hashed_features, ultimate_features, winner_features
from .trees import Growth


@dataclass
class TrainResult:
    task: str
    target: str
    threshold: float | None
    model: object | None
    scores: DataFrame | None
    status: str = "ok"
    extra: dict = field(default_factory=dict)


def enough_rows(df: DataFrame, n_min: int) -> bool:
    """At least ``n_min`` rows (stops counting at ``n_min``)."""
    return df.limit(n_min).count() >= n_min


def prepare(matches: DataFrame, start: float, stop: float) -> tuple[DataFrame, int]:
    """W1 + W2: chronological ordinal and linear recency weight."""
    m = with_ordinal(matches)
    n = m.count()
    return recency_weight(m, n, start, stop), n


def _search(task, df, features, targets: dict[str, str], grid, folds, thresholds=None) -> list[TrainResult]:
    """Run the shared-feature time-series search and wrap the results."""
    res = time_series_search(df, features, targets, grid, folds)
    return [_result(df, task, t, grid, found, thresholds) for t, found in res.items()]


def _result(df, task, t, grid, found, thresholds=None) -> TrainResult:
    model, avg, fm, best = found
    scores = cv_scores_frame(df.sparkSession, f"{task}:{t}", points(grid), avg, fm, best)
    return TrainResult(task, t, (thresholds or {}).get(t), model, scores)


def train_winner(matches: DataFrame, grid=REFERENCE_GRIDS["winner"], folds: int = 3, min_rows: int = 10) -> TrainResult:
    """M1: role-aware one-hot + team strength + side; weight 0.1 -> 1; 3 folds."""
    if not enough_rows(matches, min_rows):
        return TrainResult("match_winner", "result", None, None, None, f"need {min_rows} matches")
    df, _ = prepare(matches, 0.1, 1.0)
    return _search("match_winner", df, winner_features(), {"result": "logistic"}, grid, folds)[0]


def train_ultimate(matches: DataFrame, grid=REFERENCE_GRIDS["ultimate"], folds: int = 5, min_rows: int = 50) -> TrainResult:
    """M2: + champion and side win rates; weight 0.5 -> 1.5; 5 folds."""
    if not enough_rows(matches, min_rows):
        return TrainResult("ultimate_winner", "result", None, None, None, f"need {min_rows} matches")
    df, _ = prepare(matches, 0.5, 1.5)
    return _search("ultimate_winner", df, ultimate_features(), {"result": "logistic"}, grid, folds)[0]


def train_thresholds(task: str, matches: DataFrame, measure: str, spec, weights=(0.1, 1.0), grid=REFERENCE_GRIDS["kills"],
                     folds: int = 3, encoder_label: str = "blue_wins", min_rows: int = 10) -> list[TrainResult]:
    """M3/M4/M5 via M12: one classifier per threshold over shared features.
    ``encoder_label`` is the team encoder's target (Q4: the win label by
    default, or the threshold label itself with ``encoder_label=None``)."""
    if not enough_rows(matches, min_rows):
        return [TrainResult(task, n, t, None, None, f"need {min_rows} matches") for n, t in spec]
    df, _ = prepare(matches, *weights)
    df = over_labels_wide(df, measure, spec)
    thresholds = dict(spec)
    if encoder_label:  # one feature pipeline serves every threshold
        return _search(task, df, winner_features(encoder_label=encoder_label), {n: "logistic" for n, _ in spec}, grid, folds, thresholds)
    out = []
    for n, _ in spec:  # encoder fitted on each threshold label: features differ per target
        out += _search(task, df, winner_features(encoder_label=n), {n: "logistic"}, grid, folds, thresholds)
    return out


def train_kill_thresholds(matches_kills, **kw):
    return train_thresholds("kill_thresholds", matches_kills, "total_kills", kill_labels(), (0.1, 1.0), **kw)


def train_time_thresholds(matches_minutes, **kw):
    return train_thresholds("time_thresholds", matches_minutes, "gamelength_min", minute_labels(), (0.2, 1.0),
                            **{"grid": REFERENCE_GRIDS["minutes"], **kw})


def train_turret_thresholds(matches_turrets, **kw):
    return train_thresholds("tower_thresholds", matches_turrets, "total_turrets", turret_labels(), (0.2, 1.0),
                            **{"grid": REFERENCE_GRIDS["turrets"], **kw})


def train_total_kills(matches: DataFrame, grid=REFERENCE_GRIDS["total_kills"], folds: int = 3) -> TrainResult:
    """M6: regressor scored by MAE (lower is better); the team encoder keeps
    the win label (quirk Q3 fixed)."""
    df, _ = prepare(matches, 0.1, 1.0)
    return _search("total_kills", df, winner_features(), {"total_kills": "squared"}, grid, folds)[0]


def train_winner_and_kills(matches: DataFrame, grid=REFERENCE_GRIDS["winner"], kills_grid=REFERENCE_GRIDS["total_kills"], folds: int = 3,
                           min_rows: int = 10) -> tuple[TrainResult, TrainResult]:
    """M1 and M6 together: their matches, weights, folds and features are the same
    and are prepared once for both; each has its own grid."""
    if not enough_rows(matches, min_rows):
        return train_winner(matches, grid, folds, min_rows), train_total_kills(matches, kills_grid, folds)
    df, _ = prepare(matches, 0.1, 1.0)
    found = time_series_search(df, winner_features(), {"result": "logistic", "total_kills": "squared"}, grid, folds, grids={"total_kills": kills_grid})
    return _result(df, "match_winner", "result", grid, found["result"]), _result(df, "total_kills", "total_kills", kills_grid, found["total_kills"])


def train_length(matches_length: DataFrame, max_iter: int = 2000, depth: int = 10,
                 step: float = 0.05) -> TrainResult:
    """M7: minutes regressor, random 80/20 split (W5), ended by ten rounds without
    a better loss on a further 10% of the training part."""
    df = hash_split(matches_length.withColumn("minutes", F.col("gamelength") / 60.0), "gameid", 42, 80)
    val = token_hash(F.concat(F.col("gameid"), F.lit("#val"))) % 10 == 0
    df = written(df.withColumn("is_val", (F.col("split") == "train") & val), "length-rows")
    feats = Pipeline(stages=hashed_features(300, TeamStrengthEncoder(smoothing=20.0, labelCol="minutes", invertRed=False))).fit(df.where("split = 'train'"))
    part = F.when(F.col("is_val"), VALID).when(F.col("split") == "train", TRAIN).otherwise(TEST)
    how = Growth(rounds=max_iter, rate=step, leaves=31, depth=depth, loss="squared", patience=10)
    model = _one(feats, training_rows(feats.transform(df), 0, "gameid", ["minutes"], part), how)
    pred = model.transform(df)
    metrics = regression_metrics(pred, "minutes", "prediction", ("split",))
    resid = pred.where("split = 'test'").agg(F.stddev_pop(F.col("minutes") - F.col("prediction")).alias("s")).first()
    return TrainResult("game_length", "minutes", None, model, metrics,
                       extra={"residual_std": float(resid["s"] or 0.0)})


def _one(feats: PipelineModel, rows: DataFrame, how) -> PipelineModel:
    task = [Task(0, 0, how, keep=True)]
    return PipelineModel(stages=[*feats.stages, *models_of(fit_many(written(rows, "training"), task), task)])


def train_kill_split(matches_team_kills: DataFrame, max_iter: int = 300, depth: int = 6,
                     parallelism: int = 4) -> list[TrainResult]:
    """M8: per kill threshold, boosted trees (subsample .8, column sample .8)
    on an 80/20 chronological split (test = ceil(0.2 n) latest by game id),
    team encoder = per-side mean of the threshold label (V10)."""
    m = global_ordinal(matches_team_kills, [F.col("gameid").cast("bigint"), F.col("gameid")])
    n = m.count()
    spec = kill_labels()
    hasher = PickHasher(mode="concat", numFeatures=400, outputCol="hashed")
    df = written(hasher.transform(over_labels_wide(tail_split(m, n, 0.2), "total_kills", spec)), "split-rows")

    def one(i):
        feats = Pipeline(stages=encoded_features(TeamTargetEncoder(labelCol=spec[i][0]))).fit(df.where("split = 'train'"))
        rows = training_rows(feats.transform(df), i, "gameid", [spec[i][0]], F.when(F.col("split") == "train", TRAIN).otherwise(TEST))
        return feats, written(rows, "split-fold")

    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        folds = list(pool.map(in_session(df.sparkSession, one), range(len(spec))))
    how = Growth(rounds=max_iter, rate=0.05, leaves=0, depth=depth, min_rows=1, min_hess=1.0, l2=1.0, row_share=0.8, column_share=0.8)
    tasks = [Task(i, 0, how, (max_iter,), keep=True) for i in range(len(spec))]
    found = fit_many(_union([rows for _, rows in folds]), tasks)
    accuracy = {r["task"]: r["measure"] / max(r["n"], 1) for r in found.where("stage IS NOT NULL").collect()}
    out = []
    for i, ((name, t), model) in enumerate(zip(spec, models_of(found, tasks), strict=True)):
        scores = df.sparkSession.createDataFrame([(name, float(t), float(accuracy[i]))], "label string, threshold double, test_accuracy double")
        out.append(TrainResult("kill_threshold_split", name, t, PipelineModel(stages=[hasher, *folds[i][0].stages, model]), scores))
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def ensemble_features() -> list:
    return hashed_features(20, TeamStrengthEncoder(smoothing=10.0, labelCol="result"),
                           extra=("blue_side", "red_side"))


def oof_predictions(matches_flags: DataFrame, outer: int = 3, grid=REFERENCE_GRIDS["ensemble"], inner: int = 2,
                    parallelism: int = 4) -> DataFrame:
    """Out-of-fold probabilities of nested cross-validation over
    stratified folds (W6): for each outer fold the grid is searched on inner
    folds of the other ones, and the best point (highest mean accuracy, first on
    ties), fitted on these, scores it."""
    out = oof_scores(matches_flags, outer, grid, inner, parallelism)
    return out.select("gameid", "outer_fold", "result", "p_blue", (F.col("p_blue") > 0.5).cast("double").alias("prediction"))


def oof_by_model(scores: DataFrame) -> DataFrame:
    """E8 input: the out-of-fold rows in long form, the ensemble and each member
    as a model (model, gameid, true_class, p_blue)."""
    models = [("ensemble", "p_blue"), *[(m, f"p_{m}") for m in MEMBERS]]
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("p_blue")) for m, c in models])
    return scores.select("gameid", F.col("result").cast("int").alias("true_class"), F.inline(each)).select("model", "gameid", "true_class", "p_blue")


def oof_scores(matches_flags: DataFrame, outer: int = 3, grid=REFERENCE_GRIDS["ensemble"], inner: int = 2,
               parallelism: int = 4) -> DataFrame:
    """gameid, outer_fold, result, the members' out-of-fold probabilities and
    their average p_blue."""
    df = written(stratified_folds(matches_flags, "gameid", "result", outer, 42, "outer_fold"), "outer-folds")

    def features(train: DataFrame, test: DataFrame, fold: int) -> DataFrame:
        fitted = Pipeline(stages=ensemble_features()).fit(train)
        part = F.when(F.col("is_test"), TEST).otherwise(TRAIN)
        both = train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))
        return written(training_rows(fitted.transform(both), fold, "gameid", ["result"], part), "nested-fold")

    def rows_of(k: int) -> list[DataFrame]:
        """Fold ``k * (inner + 1) + j``: inner fold j of the outer part k; j = inner: the outer test."""
        own = df.where(F.col("outer_fold") != k)
        nested = written(stratified_folds(own, "gameid", "result", inner, 42, "inner_fold"), "inner-folds")
        out = [features(nested.where(F.col("inner_fold") != j).drop("inner_fold"), nested.where(F.col("inner_fold") == j).drop("inner_fold"), k * (inner + 1) + j) for j in range(inner)]
        return [*out, features(own, df.where(F.col("outer_fold") == k), k * (inner + 1) + inner)]

    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        rows = _union([r for part in pool.map(in_session(df.sparkSession, rows_of), range(outer)) for r in part])
    best = search_ensemble(rows, grid, {k: [k * (inner + 1) + j for j in range(inner)] for k in range(outer)})
    settings, parts = settings_of(grid)
    tasks = [Task(k * (inner + 1) + inner, 0, settings[s][1], predict=True) for k in range(outer) for s in parts[best[k][0]]]
    said = fit_many(rows, tasks).where("key IS NOT NULL").select("task", "key", "score")
    p = said.groupBy("key").agg(*[F.max(F.when(F.col("task") % len(MEMBERS) == i, F.col("score"))).alias(f"p_{m}") for i, m in enumerate(MEMBERS)])
    p = p.withColumn("p_blue", average([F.col(f"p_{m}") for m in MEMBERS]))
    return df.withColumn("key", F.xxhash64("gameid")).join(p, "key").select("gameid", "outer_fold", "result", *[f"p_{m}" for m in MEMBERS], "p_blue")


def search_ensemble(rows: DataFrame, grid: dict, folds_of: dict[int, list[int]]) -> dict[int, tuple[int, list[float]]]:
    """For each outer part (its inner folds): the best grid point's place and the
    mean accuracy of every point.  Each setting of a member is fitted once per
    fold; the points are averages of what their members say."""
    settings, parts = settings_of(grid)
    folds = sorted(f for own in folds_of.values() for f in own)
    tasks = [Task(f, 0, how, predict=True) for f in folds for _, how in settings]
    said = fit_many(rows.where(F.col("fold").isin(folds)), tasks).where("key IS NOT NULL")
    fold = F.array(*map(F.lit, folds))[(F.col("task") / len(settings)).cast("int")]
    wide = said.groupBy(fold.alias("fold"), "key").agg(*[F.max(F.when(F.col("task") % len(settings) == i, F.col("score"))).alias(f"p_{i}") for i in range(len(settings))])
    wide = wide.join(rows.where(F.col("part") == TEST).select("fold", "key", (F.col("labels")[0] > 0.5).alias("won")), ["fold", "key"])
    right = [F.avg(((average([F.col(f"p_{i}") for i in part]) > 0.5) == F.col("won")).cast("double")).alias(f"a_{j}") for j, part in enumerate(parts)]
    got = {r["fold"]: list(r)[1:] for r in wide.groupBy("fold").agg(*right).collect()}  # one row a fold
    out = {}
    for k, own in folds_of.items():
        mean = [sum(got[f][j] for f in own) / len(own) for j in range(len(parts))]
        out[k] = (first_best(mean, True), mean)
    return out


def train_towers(matches_towers: DataFrame) -> TrainResult:
    """Standardized features (V13) + RBF support vector regression, first
    int(0.8 n) matches by date for training."""
    m = with_ordinal(matches_towers)
    n = m.count()
    n_train = int(0.8 * n)
    df = written(m.withColumn("split", F.when(F.col("ordinal") < n_train, "train").otherwise("test")), "tower-rows")
    feats = Pipeline(stages=hashed_features(200, TeamStrengthEncoder(smoothing=10.0, labelCol="towers_total", invertRed=False),
                                            scale=True)).fit(df.where("split = 'train'"))
    part = F.when(F.col("split") == "train", TRAIN).otherwise(TEST)
    model = _one(feats, training_rows(feats.transform(df), 0, "gameid", ["towers_total"], part), Machine(kind="insensitive", c=1.0, epsilon=0.1))
    metrics = regression_metrics(model.transform(df), "towers_total", "prediction", ("split",))
    return TrainResult("total_towers", "towers_total", None, model, metrics)
