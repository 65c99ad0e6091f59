"""Decisions, intervals and evaluation over deterministic scores.

Tree models have no exact oracle, so evaluation operators are checked on a
deterministic score built from the champion win-rate features (V8):
``p = round(clamp(0.5 + 4 (cb - cr), 0, 1), 6)`` (model ``wr``) and
``1 - p`` (model ``inverse``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..operators import encoders as E
from ..operators import evaluate as EV
from ..models.registry import read_manifest, saved_thresholds, write_manifest
from ..operators.labels import kill_labels, minute_labels, over_labels_long, turret_labels
from ..operators.matches import matches_kills, matches_minutes, matches_turrets
from ..operators.ordering import hash_split, recency_weight, with_ordinal
from ..session import scratch_path
from ..sources.fixture import match_rows, with_ctes
from ..functions.hashing import duck_hash
from .common import base_matches, round_doubles
from .q_features import _CHAMP_FEATURES
from .q_matches import MATCHES_CTES
from .registry import ORACLE, register

def bround_sql(expr: str, digits: int) -> str:
    """DuckDB text matching Spark ``bround`` on a double: half-even on the
    double's shortest decimal representation."""
    return f"CAST(round_even(CAST(CAST(CAST(({expr}) AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 20)), {digits}) AS DOUBLE)"


_SCORED = [*_CHAMP_FEATURES, """sc0 AS (
  SELECT gameid, result AS true_class, total_kills, gamelength,
         round(blue_champ_wr, 6) AS cb, round(red_champ_wr, 6) AS cr,
         round(least(greatest(0.5 + 4 * (round(blue_champ_wr, 6) - round(red_champ_wr, 6)), 0.0), 1.0), 6) AS p
  FROM cf)""", """scored AS (
  SELECT 'wr' AS model, gameid, true_class, p AS p_blue FROM sc0
  UNION ALL SELECT 'inverse', gameid, true_class, round(1 - p, 6) FROM sc0)""", """dec AS (
  SELECT *, greatest(p_blue, 1 - p_blue) AS confidence, CAST(p_blue > 0.5 AS INT) AS predicted_class,
         CAST((CAST(p_blue > 0.5 AS INT)) = true_class AS INT) AS correct FROM scored)"""]


def _m(*ctes, select):
    return with_ctes(*MATCHES_CTES, *_SCORED, *ctes, select=select)


def champ_features(spark, sf) -> DataFrame:
    m = base_matches(spark, sf, reuse=True)
    model = E.ChampionWinRateEstimator(smoothing=10.0).fit(m)
    f = round_doubles(model.transform(m))
    return f.select("gameid", F.col("result").alias("true_class"), "total_kills", "gamelength",
                    F.col("blue_champ_wr").alias("cb"), F.col("red_champ_wr").alias("cr"))


def scored(spark, sf) -> DataFrame:
    """Long (model, gameid, true_class, p_blue) for the two deterministic models."""
    f = champ_features(spark, sf)
    p = F.round(F.least(F.greatest(F.lit(0.5) + F.lit(4.0) * (F.col("cb") - F.col("cr")), F.lit(0.0)),
                        F.lit(1.0)), 6)
    f = f.withColumn("p", p)
    both = F.array(F.struct(F.lit("wr").alias("model"), F.col("p").alias("p_blue")),
                   F.struct(F.lit("inverse").alias("model"), F.round(F.lit(1.0) - F.col("p"), 6).alias("p_blue")))
    return f.select("gameid", "true_class", F.inline(both))


def decided(spark, sf) -> DataFrame:
    s = scored(spark, sf)
    return (s.withColumn("confidence", D.confidence("p_blue"))
             .withColumn("predicted_class", D.predicted_class("p_blue"))
             .withColumn("correct", (F.col("predicted_class") == F.col("true_class")).cast("int")))


@register("decide", _m(select="""
SELECT model, gameid, p_blue, round(confidence, 6) AS confidence, predicted_class,
       CASE WHEN p_blue > 0.5 THEN 'Blue' ELSE 'Red' END AS winner FROM dec"""))
def q_decide(spark, sf):
    d = decided(spark, sf)
    return round_doubles(d.select("model", "gameid", "p_blue", "confidence", "predicted_class",
                                  D.winner_text("p_blue").alias("winner")))


def _bins_sql(variant: str, percent: bool) -> str:
    edges = EV.bin_edges(variant)
    start, step, n, closed, lowest, zero = EV.BIN_VARIANTS[variant]
    vals = ", ".join(f"({i}, {lo}, {hi}, '{lab}')" for i, lo, hi, lab in edges)
    if closed == "right":
        cond = "(d.confidence > b.lo AND d.confidence <= b.hi)"
        if lowest:
            cond = f"({cond} OR (b.bin_no = 0 AND d.confidence = b.lo))"
    else:
        cond = "(d.confidence >= b.lo AND d.confidence < b.hi)"
    if percent:
        metrics = (f"{bround_sql('coalesce(avg(d.correct), 0) * 100', 1)} AS accuracy, "
                   f"{bround_sql('coalesce(avg(d.confidence), 0) * 100', 1)} AS expected_accuracy")
    else:
        metrics = "round(coalesce(avg(d.correct), 0), 6) AS accuracy"
    body = f"""
SELECT mm.model, b.bin_no, b.bin, count(d.gameid) AS count, {metrics}
FROM (SELECT DISTINCT model FROM dec) mm
CROSS JOIN (SELECT * FROM (VALUES {vals}) t(bin_no, lo, hi, bin)) b
LEFT JOIN dec d ON d.model = mm.model AND {cond}
GROUP BY mm.model, b.bin_no, b.bin"""
    if not zero:
        body = f"SELECT * FROM ({body}) WHERE count > 0"
    return body


def _bins(spark, sf, variant, percent):
    return round_doubles(EV.confidence_bins(decided(spark, sf), variant, percent=percent))


@register("calibration_bins", _m(select=_bins_sql("calibration", True)))
def q_calibration_bins(spark, sf):
    """Ten 5-point bins from 50%, right-closed, lowest included, zero-filled."""
    return _bins(spark, sf, "calibration", True)


@register("confidence_bins_left", _m(select=_bins_sql("left", False)))
def q_confidence_bins_left(spark, sf):
    """Ten 10-point bins from 0, left-closed (1.0 falls out), zero-filled."""
    return _bins(spark, sf, "left", False)


@register("confidence_bins_top", _m(select=_bins_sql("top", False)))
def q_confidence_bins_top(spark, sf):
    """Five bins 0.5-1.0, right-closed (0.5 falls out), empty bins hidden."""
    return _bins(spark, sf, "top", False)


@register("confidence_bins_right", _m(select=_bins_sql("right", False)))
def q_confidence_bins_right(spark, sf):
    """Ten bins 0-1.0, right-closed, lowest included, zero-filled."""
    return _bins(spark, sf, "right", False)


@register("accuracy", _m(select="""
SELECT model, round(avg(correct), 6) AS accuracy, count(*) AS n FROM dec GROUP BY model"""))
def q_accuracy(spark, sf):
    return round_doubles(EV.accuracy(decided(spark, sf), group_cols=("model",)))


@register("weighted_accuracy", _m("""wo AS (
  SELECT gameid, row_number() OVER (ORDER BY date, CAST(gameid AS BIGINT)) - 1 AS ordinal, count(*) OVER () AS n FROM matches)""", """wt AS (
  SELECT gameid, CASE WHEN n = 1 THEN 0.2 ELSE 0.2 + 0.8 * ordinal / (n - 1) END AS w FROM wo)""", select="""
SELECT model, round(sum(w * correct) / sum(w), 6) AS accuracy, count(*) AS n FROM dec JOIN wt USING (gameid) GROUP BY model"""))
def q_weighted_accuracy(spark, sf):
    """E5, weighted: accuracy with the recency weights 0.2 -> 1 of the minute models."""
    m = with_ordinal(base_matches(spark, sf))
    w = recency_weight(m, m.count(), 0.2, 1.0).select("gameid", "weight")
    return round_doubles(EV.accuracy(decided(spark, sf).join(w, "gameid"), group_cols=("model",), weight="weight"))


@register("confusion_matrix", _m("""cells AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(true_class, predicted_class))""", select="""
SELECT c.true_class, c.predicted_class, count(d.gameid) AS count
FROM cells c LEFT JOIN (SELECT * FROM dec WHERE model = 'wr') d
  ON d.true_class = c.true_class AND d.predicted_class = c.predicted_class
GROUP BY c.true_class, c.predicted_class"""))
def q_confusion_matrix(spark, sf):
    return EV.confusion_matrix(decided(spark, sf).where("model = 'wr'"))


@register("class_report", _m("""cm AS (
  SELECT k, count(*) FILTER (WHERE true_class = k AND predicted_class = k) AS tp,
         count(*) FILTER (WHERE predicted_class = k) AS np, count(*) FILTER (WHERE true_class = k) AS sup
  FROM (SELECT * FROM dec WHERE model = 'wr') d CROSS JOIN (VALUES (0), (1)) t(k) GROUP BY k)""", """pc AS (
  SELECT CAST(k AS VARCHAR) AS label,
         CASE WHEN np > 0 THEN tp / np ELSE 0 END AS precision,
         CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS recall, sup AS support FROM cm)""", """pf AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
  FROM pc)""", select="""
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pf
UNION ALL
SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM pf
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pf"""))
def q_class_report(spark, sf):
    return round_doubles(EV.class_report(decided(spark, sf).where("model = 'wr'")))


@register("model_comparison", _m(select="""
SELECT model, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(confidence), 6) AS mean_confidence
FROM dec GROUP BY model"""))
def q_model_comparison(spark, sf):
    """Several models over one labelled set, grouped by model."""
    d = decided(spark, sf)
    return round_doubles(d.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"),
        F.avg("confidence").alias("mean_confidence")))


@register("calibration_gap", _m(f"cb AS ({_bins_sql('calibration', True)})", select=f"""
SELECT model, bin, {bround_sql('accuracy - expected_accuracy', 1)} AS diff,
       CASE WHEN accuracy > 70 THEN 'high' WHEN accuracy < 50 THEN 'low' ELSE 'mid' END AS tier,
       abs({bround_sql('accuracy - expected_accuracy', 1)}) <= 2 AS within_2,
       CAST(accuracy AS VARCHAR) || '%' AS accuracy_text
FROM cb"""))
def q_calibration_gap(spark, sf):
    """per calibration bin, the accuracy gap, its tier and the +-2 check."""
    b = _bins(spark, sf, "calibration", True)
    diff = F.bround(F.col("accuracy") - F.col("expected_accuracy"), 1)
    return round_doubles(b.select("model", "bin", diff.alias("diff"), D.accuracy_tier("accuracy").alias("tier"),
                                  (F.abs(diff) <= 2).alias("within_2"),
                                  F.concat(F.col("accuracy").cast("string"), F.lit("%")).alias("accuracy_text")))


# --- M10: soft vote of four fixed scores --------------------------------------

@register("soft_vote", _m(select="""
SELECT gameid, true_class, round(p_blue, 8) AS p_blue, CAST(p_blue > 0.5 AS INT) AS predicted_class FROM (
  SELECT gameid, true_class,
         (p + (1 - p) + least(greatest(0.5 + 2 * (cb - cr), 0.0), 1.0)
            + least(greatest(0.5 + 8 * (cb - cr), 0.0), 1.0)) / 4 AS p_blue
  FROM sc0)"""))
def q_soft_vote(spark, sf):
    """M10 arithmetic: mean of the members' blue probabilities."""
    f = champ_features(spark, sf)
    d = F.col("cb") - F.col("cr")

    def clamp(x):
        return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))

    p = F.round(clamp(F.lit(0.5) + 4 * d), 6)
    members = [p, F.lit(1.0) - p, clamp(F.lit(0.5) + 2 * d), clamp(F.lit(0.5) + 8 * d)]
    avg = sum(members[1:], members[0]) / F.lit(float(len(members)))
    # inputs have 6 decimals, so the mean of four is exact at 8
    return f.select("gameid", "true_class", F.round(avg, 8).alias("p_blue"),
                    D.predicted_class(avg).alias("predicted_class"))


# --- F10-F12, F11, E7 on a deterministic point estimate -------------------------

_X = "30 + 20 * (cb - cr)"  # deterministic 'predicted minutes'


@register("interval_fixed", _m(select=f"""
SELECT gameid, {bround_sql(_X, 1)} AS predicted, {bround_sql(f'greatest(0, {_X} - 2)', 1)} AS low,
       {bround_sql(f'{_X} + 2', 1)} AS high, greatest(0, {bround_sql(f'{_X} - 2', 1)}) AS tower_low
FROM sc0"""))
def q_interval_fixed(spark, sf):
    f = champ_features(spark, sf)
    x = F.lit(30.0) + F.lit(20.0) * (F.col("cb") - F.col("cr"))
    pt, lo, hi = D.interval_fixed(x)
    tlo, _ = D.tower_range(x)
    return f.select("gameid", pt.alias("predicted"), lo.alias("low"), hi.alias("high"), tlo.alias("tower_low"))


@register("interval_residual", _m(f"""rs AS (SELECT stddev_pop(gamelength / 60.0 - ({_X})) AS s FROM sc0)""", select=f"""
SELECT gameid, round({_X}, 6) AS predicted, round({_X} - 2 * s, 6) AS low, round({_X} + 2 * s, 6) AS high
FROM sc0, rs"""))
def q_interval_residual(spark, sf):
    """+- 2 residual standard deviations (population, A13)."""
    f = champ_features(spark, sf).withColumn("x", F.lit(30.0) + F.lit(20.0) * (F.col("cb") - F.col("cr")))
    s = E.scalar(f, F.stddev_pop(F.col("gamelength") / 60.0 - F.col("x")), 0.0)
    return round_doubles(f.select("gameid", F.col("x").alias("predicted"),
                                  (F.col("x") - 2 * s).alias("low"), (F.col("x") + 2 * s).alias("high")))


@register("regression_metrics", _m(f"""rg AS (
  SELECT CASE WHEN {duck_hash("gameid || '#42'")} % 100 < 80 THEN 'train' ELSE 'test' END AS split,
         total_kills AS y, 25 + 40 * (cb - cr) AS pred FROM sc0)""", select="""
SELECT split, round(avg(abs(y - pred)), 6) AS mae, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse,
       round(CASE WHEN var_pop(y) * count(*) > 0 THEN 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*))
             ELSE 0 END, 6) AS r2, count(*) AS n
FROM rg GROUP BY split"""))
def q_regression_metrics(spark, sf):
    """MAE, RMSE, R^2 on train and test (hash split) for a fixed estimate."""
    f = hash_split(champ_features(spark, sf), "gameid", 42, 80)
    f = f.withColumn("pred", F.lit(25.0) + F.lit(40.0) * (F.col("cb") - F.col("cr")))
    return round_doubles(EV.regression_metrics(f, "total_kills", "pred", ("split",)))


# --- F14 / W11 -----------------------------------------------------------------

# task -> (measure, label names, prefix of the reference's model files)
_SAVED = {"kills": ("total_kills", kill_labels(), ""), "time": ("gamelength_min", minute_labels(), "time_"),
          "turrets": ("total_turrets", turret_labels(), "")}


def _files_sql() -> list[str]:
    vals = ", ".join(f"('{task}', '{prefix}{n}.joblib')" for task, (_, spec, prefix) in _SAVED.items() for n, _ in spec)
    loaders = {"kills": "matches_kills", "time": "matches_minutes", "turrets": "matches_turrets"}
    union = " UNION ALL ".join(f"SELECT '{task}' AS task, CAST({_SAVED[task][0]} AS DOUBLE) AS v FROM ({ORACLE[q]}) x_{task}" for task, q in loaders.items())
    return [f"measured AS ({union})", f"""files AS (
  SELECT f.task, f.file, {_PARSE} AS threshold FROM (VALUES {vals}) f(task, file))""", """counted AS (
  SELECT f.task, f.file, f.threshold, count(*) FILTER (m.v > f.threshold) AS n_over, count(*) AS n
  FROM files f JOIN measured m ON m.task = f.task GROUP BY ALL)"""]


_PARSE = """CASE WHEN regexp_matches(file, 'over_[0-9]+_[0-9]+')
     THEN CAST(regexp_extract(file, 'over_([0-9]+)_([0-9]+)', 1) || '.' || regexp_extract(file, 'over_([0-9]+)_([0-9]+)', 2) AS DOUBLE)
     ELSE CAST(regexp_extract(file, 'over_([0-9]+)', 1) AS DOUBLE) END"""


@register("parse_threshold", with_ctes(*_files_sql(), select="SELECT task, file, threshold, n_over, n FROM counted"))
def q_parse_threshold(spark, sf):
    """thresholds parsed from the paths of a saved manifest, and how many
    matches of the task's loader lie over each."""
    return _saved_thresholds(spark, sf).drop("position")


@register("sorted_thresholds", with_ctes(*_files_sql(), select="""
SELECT task, file, threshold, CAST(row_number() OVER (PARTITION BY task ORDER BY threshold) AS INT) AS position,
       n_over, n - n_over AS n_under FROM counted"""))
def q_sorted_thresholds(spark, sf):
    """The saved models of a task in the order of the number in their path."""
    return _saved_thresholds(spark, sf).withColumn("n_under", F.col("n") - F.col("n_over")).drop("n")


def _saved_thresholds(spark, sf):
    base = scratch_path(spark, "thresholds")
    rows = [(task, f"{prefix}{n}.joblib", None, f"{base}/{task}/{prefix}{n}.joblib", "ok") for task, (_, spec, prefix) in _SAVED.items() for n, _ in spec]
    write_manifest(spark, rows, base)
    saved = saved_thresholds(read_manifest(spark, base)).withColumn("file", F.element_at(F.split("path", "/"), -1))
    loaders = {"kills": matches_kills, "time": matches_minutes, "turrets": matches_turrets}
    counted = None
    for task, load in loaders.items():
        # one row a saved model
        spec = [(r["file"], r["threshold"]) for r in saved.where(F.col("task") == task).select("file", "threshold").collect()]
        own = over_labels_long(load(match_rows(spark, sf)), _SAVED[task][0], spec).groupBy(F.col("label").alias("file")).agg(
            F.coalesce(F.sum("over"), F.lit(0)).cast("bigint").alias("n_over"), F.count(F.lit(1)).alias("n"))
        counted = own.withColumn("task", F.lit(task)) if counted is None else counted.unionByName(own.withColumn("task", F.lit(task)))
    return saved.join(counted, ["task", "file"]).select("task", "file", "threshold", "position", "n_over", "n")
