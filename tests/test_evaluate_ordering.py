"""Bin edge semantics, folds, splits and weights."""

import datetime as dt

from pyspark.sql import functions as F

from draftspark.operators import evaluate as EV
from draftspark.operators import ordering as O


def _scored(spark, confs):
    rows = [("m", c, int(i % 2 == 0)) for i, c in enumerate(confs)]
    return spark.createDataFrame(rows, "model string, confidence double, correct int")


def _bins(df, variant):
    return {r.bin: r["count"] for r in EV.confidence_bins(df, variant).collect()}


def test_calibration_bins_right_closed_lowest_included(spark):
    b = _bins(_scored(spark, [0.5, 0.55, 0.6, 0.6000001, 1.0]), "calibration")
    assert len(b) == 10 and sum(b.values()) == 5        # zero-filled, every row binned
    assert b["50-55%"] == 2 and b["55-60%"] == 1 and b["60-65%"] == 1 and b["95-100%"] == 1


def test_left_closed_drops_one(spark):
    b = _bins(_scored(spark, [0.5, 0.6, 0.99, 1.0]), "left")
    assert b["50-60%"] == 1 and b["60-70%"] == 1 and b["90-100%"] == 1 and sum(b.values()) == 3


def test_top_bins_hide_empty_and_drop_half(spark):
    b = _bins(_scored(spark, [0.5, 0.55, 0.95]), "top")
    assert b == {"50-60%": 1, "90-100%": 1}


def test_right_bins_include_zero(spark):
    b = _bins(_scored(spark, [0.0, 0.1, 0.15, 1.0]), "right")
    assert b["0-10%"] == 2 and b["10-20%"] == 1 and b["90-100%"] == 1


def test_calibration_percent_and_empty_bins(spark):
    out = EV.confidence_bins(_scored(spark, [0.52, 0.53]), "calibration", percent=True).collect()
    first = [r for r in out if r.bin == "50-55%"][0]
    assert first["count"] == 2 and first.accuracy == 50.0 and first.expected_accuracy == 52.5
    empty = [r for r in out if r.bin == "90-95%"][0]
    assert (empty["count"], empty.accuracy, empty.expected_accuracy) == (0, 0.0, 0.0)


def _ordered(spark, n, ties=False):
    d0 = dt.datetime(2024, 1, 1)
    rows = [(str(i), d0 + dt.timedelta(days=(0 if ties else i))) for i in range(n)]
    return O.with_ordinal(spark.createDataFrame(rows, "gameid string, date timestamp"))


def test_ordinal_is_dense_and_follows_order(spark):
    o = _ordered(spark, 103, ties=True).collect()
    by = sorted(o, key=lambda r: r.ordinal)
    assert [r.ordinal for r in by] == list(range(103))
    assert [int(r.gameid) for r in by] == list(range(103))   # ties by numeric id


def test_time_folds_are_disjoint_and_later(spark):
    o = _ordered(spark, 103)
    f = O.time_folds(o, 103, 3).collect()
    assert O.fold_bounds(103, 3) == [(0, 28, 53), (1, 53, 78), (2, 78, 103)]
    for k in range(3):
        tr = {r.ordinal for r in f if r.fold == k and r.role == "train"}
        te = {r.ordinal for r in f if r.fold == k and r.role == "test"}
        assert tr and te and not tr & te and max(tr) < min(te)


def test_weights_tail_split_hash_split(spark):
    o = _ordered(spark, 11)
    w = {r.ordinal: r.weight for r in O.recency_weight(o, 11, 0.1, 1.0).collect()}
    assert abs(w[0] - 0.1) < 1e-12 and abs(w[10] - 1.0) < 1e-12 and abs(w[5] - 0.55) < 1e-12
    one = O.recency_weight(_ordered(spark, 1), 1, 0.5, 1.5).first()
    assert one.weight == 0.5
    s = O.tail_split(o, 11, 0.2).where("split = 'test'").agg(F.min("ordinal"), F.count("*")).first()
    assert tuple(s) == (8, 3)     # ceil(0.2 * 11) = 3 latest rows
    h1 = {r.gameid: r.split for r in O.hash_split(o, "gameid").collect()}
    h2 = {r.gameid: r.split for r in O.hash_split(o.repartition(3), "gameid").collect()}
    assert h1 == h2               # stable across partitioning


def test_stratified_folds_balanced(spark):
    rows = [(str(i), i % 2) for i in range(60)]
    df = O.stratified_folds(spark.createDataFrame(rows, "gameid string, result int"), "gameid", "result", 3)
    counts = {(r.result, r.fold): r["count"] for r in df.groupBy("result", "fold").count().collect()}
    assert sorted(counts.values()) == [10] * 6
