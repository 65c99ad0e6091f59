"""Model training, CV, registry and scoring queries.

Trained models have no SQL oracle: these keys are rows-only checks.  They run
the reference's training on the whole fixture, with the reference grids
(``grids.REFERENCE_GRIDS``) or fixed iterations and depths that the training
functions have as defaults; labels are noise, so model quality is not a test.
Trained results are memoized per (session, sf, task) so the scoring query
reuses the models the training queries fit.
"""

from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from ..functions import decisions as D
from ..models import train as T
from ..models.registry import load_registry, registry_check, registry_from_results, save_registry
from ..models.score import result_json, score_all
from ..operators import matches as M
from ..operators.evaluate import accuracy
from ..operators.roles import role_stats_long
from ..session import in_session, scratch_path, session_key, written
from ..sources.fixture import drafts, match_rows
from . import q_ordering  # noqa: F401 - its statement for the weights is used here
from .common import round_doubles
from .registry import ORACLE, register

_CACHE: dict = {}
_LOCKS: dict = {}


def _memo(spark, sf, task, fn):
    key = (session_key(spark), sf, task)
    with _LOCKS.setdefault(key, threading.Lock()):  # tasks that are trained at the same time share what they need
        if key not in _CACHE:
            _CACHE[key] = fn()
    return _CACHE[key]


def _matches(spark, sf, loader):
    """The loader's matches, written: training reads them more than once, and several tasks read the same ones."""
    return _memo(spark, sf, loader.__name__, lambda: written(loader(match_rows(spark, sf)), "matches"))


def _union(frames):
    frames = [f for f in frames if f is not None]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def winner_and_kills(spark, sf):
    """(winner, total kills); prepared once unless one of them is there already."""
    if any((session_key(spark), sf, task) in _CACHE for task in ("winner", "total_kills")):
        return winner(spark, sf), total_kills(spark, sf)
    return _memo(spark, sf, "winner_and_kills", lambda: T.train_winner_and_kills(_matches(spark, sf, M.matches)))


def winner(spark, sf):
    if (both := _CACHE.get((session_key(spark), sf, "winner_and_kills"))):
        return both[0]
    return _memo(spark, sf, "winner", lambda: T.train_winner(_matches(spark, sf, M.matches)))


def kill_thresholds(spark, sf):
    return _memo(spark, sf, "kill_thresholds", lambda: T.train_kill_thresholds(_matches(spark, sf, M.matches_kills)))


def ultimate(spark, sf):
    return _memo(spark, sf, "ultimate", lambda: T.train_ultimate(_matches(spark, sf, M.matches)))


def time_thresholds(spark, sf):
    return _memo(spark, sf, "time_thresholds", lambda: T.train_time_thresholds(_matches(spark, sf, M.matches_minutes)))


def turret_thresholds(spark, sf):
    return _memo(spark, sf, "turret_thresholds", lambda: T.train_turret_thresholds(_matches(spark, sf, M.matches_turrets)))


def total_kills(spark, sf):
    if (both := _CACHE.get((session_key(spark), sf, "winner_and_kills"))):
        return both[1]
    return _memo(spark, sf, "total_kills", lambda: T.train_total_kills(_matches(spark, sf, M.matches)))


def length(spark, sf):
    return _memo(spark, sf, "length", lambda: T.train_length(_matches(spark, sf, M.matches_length)))


def towers(spark, sf):
    return _memo(spark, sf, "towers", lambda: T.train_towers(_matches(spark, sf, M.matches_towers)))


@register("winner_model")
def q_winner_model(spark, sf):
    """M1 + M9: CV scores per grid point and fold (expanding windows, 3 folds)."""
    return winner(spark, sf).scores


@register("ultimate_model")
def q_ultimate_model(spark, sf):
    """M2: ultimate feature set, weight 0.5 -> 1.5, 5 expanding folds."""
    return ultimate(spark, sf).scores


@register("kill_threshold_models")
def q_kill_threshold_models(spark, sf):
    """M3 via M12: 15 kill thresholds over one shared feature pipeline per fold."""
    return _union([r.scores for r in kill_thresholds(spark, sf)])


@register("time_threshold_models")
def q_time_threshold_models(spark, sf):
    """M4: 8 minute thresholds (weights 0.2 -> 1)."""
    return _union([r.scores for r in time_thresholds(spark, sf)])


@register("turret_threshold_models")
def q_turret_threshold_models(spark, sf):
    """M5: 5 turret thresholds (``over_10_5`` = more than 10)."""
    return _union([r.scores for r in turret_thresholds(spark, sf)])


@register("kills_model")
def q_kills_model(spark, sf):
    """M6: total-kills regressor, MAE-scored CV."""
    return total_kills(spark, sf).scores


@register("length_model")
def q_length_model(spark, sf):
    """M7: minutes regressor with early stopping; E7 metrics and A13 residual std."""
    r = length(spark, sf)
    return r.scores.withColumn("residual_std", F.lit(r.extra["residual_std"]))


@register("kill_threshold_split")
def q_kill_threshold_split(spark, sf):
    """M8: per kill threshold, test accuracy on the latest 20%."""
    res = _memo(spark, sf, "kill_split",
                lambda: T.train_kill_split(_matches(spark, sf, M.matches_team_kills)))
    return _union([r.scores for r in res])


@register("towers_model")
def q_towers_model(spark, sf):
    """Standardized features + boosted regressor, 80/20 by date; E7 metrics."""
    return towers(spark, sf).scores


@register("oof_predictions")
def q_oof_predictions(spark, sf):
    """M10 + M11: soft-vote ensemble, out-of-fold probabilities over 3
    stratified outer folds, its grid searched on 2 inner folds of each."""
    return T.oof_predictions(_matches(spark, sf, M.matches_flags), outer=3)


@register("oof_comparison")
def q_oof_comparison(spark, sf):
    """E8 on trained models: the ensemble and its members over the same
    out-of-fold rows, with accuracy and mean confidence."""
    rows = T.oof_by_model(T.oof_scores(_matches(spark, sf, M.matches_flags), outer=3))
    rows = rows.withColumn("predicted_class", D.predicted_class("p_blue")).withColumn("confidence", D.confidence("p_blue"))
    return accuracy(rows, group_cols=("model",)).join(rows.groupBy("model").agg(F.avg("confidence").alias("mean_confidence")), "model")


@register("grid_best")
def q_grid_best(spark, sf):
    """Best grid point (highest mean score, first on ties) per task."""
    s = _union([r.scores for r in winner_and_kills(spark, sf)])
    return s.where("is_best").groupBy("task", "grid_point", "params").agg(F.first("mean_score").alias("mean_score"))


@register("cv_scores")
def q_cv_scores(spark, sf):
    """Mean CV score per task and grid point."""
    s = _union([r.scores for r in winner_and_kills(spark, sf)])
    return s.groupBy("task", "grid_point", "params").agg(F.avg("score").alias("mean_score"),
                                                         F.count(F.lit(1)).alias("folds"))


def _results(spark, sf):
    """All models that the scorer knows: 5 single ones and 28 thresholds.  The
    tasks are independent and trained at the same time: while some prepare their
    folds, in many short jobs, the fits of others use the slots."""
    match_rows(spark, sf)
    tasks = [kill_thresholds, time_thresholds, ultimate, turret_thresholds, winner_and_kills, length, towers]
    with ThreadPoolExecutor(len(tasks)) as pool:
        done = list(pool.map(in_session(spark, lambda task: task(spark, sf)), tasks))
    return [r for result in done for r in (result if isinstance(result, (list, tuple)) else [result])]


@register("registry_check")
def q_registry_check(spark, sf):
    """Save the trained models with a manifest, load them back
    (skipping failures) and check the expected tasks."""
    base = scratch_path(spark, "registry")
    save_registry(spark, _results(spark, sf), base)
    reg = load_registry(spark, base)
    return registry_check(reg.manifest)


def scorer(spark, sf):
    """(registry of all trained models, champions seen in training)."""
    reg = registry_from_results(spark, _results(spark, sf))
    m = _matches(spark, sf, M.matches)
    return reg, role_stats_long(m).select("champion").checkpoint(eager=True)


def _scored(spark, sf):
    def run():
        reg, seen = scorer(spark, sf)
        return score_all(drafts(match_rows(spark, sf)), reg, seen)
    return _memo(spark, sf, "scored", run)


@register("score_all")
def q_score_all(spark, sf):
    """Every draft (valid and rejected) scored by every trained model,
    with the no-team counterfactual, intervals, threshold maps and quality."""
    return _scored(spark, sf)


@register("result_json")
def q_result_json(spark, sf):
    """The nested results as JSON documents."""
    return result_json(_scored(spark, sf))


@register("match_ordinal_weights", ORACLE["recency_weight"])
def q_match_ordinal_weights(spark, sf):
    """W1 + W2 as used by training: ordinal and the 0.1 -> 1 weight per match."""
    m, _ = T.prepare(M.matches(match_rows(spark, sf)), 0.1, 1.0)
    return round_doubles(m.select("gameid", "ordinal", "weight"))

