"""Trees grown in the JVM against those of ``trees.py``."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from draftspark.models import fitted, lockstep
from draftspark.models.trees import Growth

N, WIDTH = 500, 14
HOWS = [Growth(rounds=8, leaves=7), Growth(rounds=8, leaves=31, l1=0.3, column_share=0.6), Growth(rounds=6, leaves=0, depth=4, min_rows=1, min_hess=1.0, l2=1.0, row_share=0.8, column_share=0.8),
        Growth(rounds=6, rate=1.0, leaves=0, depth=-1, min_rows=1, min_hess=0.0, split_columns=-1.0, loss="forest"), Growth(rounds=60, l2=0.5, patience=4, holdout=0.1),
        Growth(rounds=40, depth=3, patience=3), Growth(rounds=3, depth=0)]
SQUARED = [Growth(rounds=8, loss="squared"), Growth(rounds=8, leaves=40, depth=3, loss="squared"), Growth(rounds=8, leaves=40, depth=15, loss="squared")]


@pytest.fixture(scope="module")
def rows(spark):
    """Signs, numbers of either sign, one column of more values than bins and one without any; dense and sparse."""
    rng = np.random.default_rng(1)
    x = rng.choice([-1.0, 0.0, 0.0, 0.0, 1.0], (N, WIDTH))
    x[:, -1], x[:, -2], x[:, -3], x[:, -4] = rng.random(N), rng.normal(0, 1, N), np.round(rng.normal(0, 2, N)), 0.0
    y = x[:, 0] + x[:, 1] * x[:, 2] + x[:, -1] + x[:, -2] + rng.normal(0, 0.5, N) > 0.5
    data = [(f"g{i}", i, float(rng.random() + 0.5), float(y[i]), float(x[i, -1] + x[i, -3]),
             Vectors.dense(x[i].tolist()) if i % 3 else Vectors.sparse(WIDTH, {int(k): float(x[i, k]) for k in np.flatnonzero(x[i])})) for i in range(N)]
    df = spark.createDataFrame(data, ["gameid", "ordinal", "weight", "result", "total", "features"])
    part = F.when(F.col("ordinal") < 330, fitted.TRAIN).when(F.col("ordinal") < 380, fitted.VALID).otherwise(fitted.TEST)
    out = fitted.training_rows(df, 0, "gameid", ["result", "total"], part, "weight")
    return out.unionByName(out.where("part <> 1").withColumn("fold", F.lit(3))).cache()


def found(rows, tasks):
    got = fitted.fit_many(rows, tasks)
    return (sorted((r.task, r.stage, r.measure, r.n, r.base) for r in got.where("stage IS NOT NULL").collect()),
            {(r.task, r.tree): r.nodes for r in got.where("tree IS NOT NULL").collect()}, {(r.task, r.key): r.score for r in got.where("key IS NOT NULL").collect()})


def test_trees_equal_those_in_python(rows, monkeypatch):
    tasks = [fitted.Task(f, t, how, (2, how.rounds), keep=True, predict=True) for f in (0, 3) for t, hows in ((0, HOWS), (1, SQUARED)) for how in hows]
    stages, trees, scores = found(rows, tasks)
    monkeypatch.setattr(fitted, "WHOLE_ROWS", 0)
    stages_, trees_, scores_ = found(rows, tasks)
    assert np.allclose(stages, stages_) and trees.keys() == trees_.keys() and scores.keys() == scores_.keys()
    for k, a in trees.items():
        b = trees_[k]
        assert (a.feature, a.left, a.right) == (b.feature, b.left, b.right) and np.allclose(a.bound, b.bound) and np.allclose(a.value, b.value)
    assert all(abs(scores[k] - scores_[k]) < 1e-9 for k in scores)


def test_a_fold_of_more_rows_than_a_shard_needs_no_exchange(rows, monkeypatch):
    """An exchange takes Spark about a second, and a tree as many as it has levels."""
    monkeypatch.setattr(lockstep, "SHARD_ROWS", 100)
    monkeypatch.setattr(fitted, "in_lockstep", None)
    stages, _, _ = found(rows, [fitted.Task(0, 0, Growth(rounds=300, leaves=40), (300,))])
    assert [s[:2] for s in stages] == [(0, 300)]


def test_missing_labels_split_nothing(rows):
    """As with the sums of trees.py, which are not a number then either."""
    none = rows.withColumn("labels", F.array(F.lit(None).cast("double"), F.col("labels")[1]))
    stages, trees, _ = found(none, [fitted.Task(0, 0, Growth(rounds=3), (3,), keep=True), fitted.Task(0, 1, Growth(rounds=3, loss="squared"), (3,), keep=True)])
    assert len(trees[0, 0].feature) == 1 and len(trees[1, 0].feature) > 1 and len(stages) == 2


def test_targets_with_grids_of_their_own_equal_separate_searches(rows, spark):
    """One preparation of the folds for both, the same scores and best points."""
    from pyspark.ml.feature import VectorAssembler

    from draftspark.models.cv import time_series_search

    rng = np.random.default_rng(2)
    data = [(f"g{i}", i, 1.0, float(rng.integers(0, 2)), float(rng.normal()), Vectors.dense(rng.normal(0, 1, 4).tolist())) for i in range(160)]
    df = spark.createDataFrame(data, ["gameid", "ordinal", "weight", "result", "total", "raw"])
    stages = [VectorAssembler(inputCols=["raw"], outputCol="features")]
    first, second = {"n_estimators": [2, 4], "num_leaves": [3]}, {"n_estimators": [3], "num_leaves": [3, 4], "learning_rate": [0.1, 0.3]}
    both = time_series_search(df, stages, {"result": "logistic", "total": "squared"}, first, 2, grids={"total": second})
    for target, loss, grid in (("result", "logistic", first), ("total", "squared", second)):
        assert both[target][1:] == time_series_search(df, stages, {target: loss}, grid, 2)[target][1:]


def test_a_machine_on_many_rows_holds_them_in_files(rows, monkeypatch):
    """Neither the rows that a task is given nor the machine's map have to fit its memory."""
    import tracemalloc

    import pyarrow as pa

    from draftspark.models import kernel, trees

    n, width = 6000, 40
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (n, width))
    features = pa.StructArray.from_arrays([pa.array([1] * n, pa.int8()), pa.array([None] * n, pa.int32()), pa.array([None] * n, pa.list_(pa.int32())), pa.array(x.tolist(), pa.list_(pa.float64()))],
                                          ["type", "size", "indices", "values"])
    t = pa.table({"key": pa.array(rng.integers(0, 1 << 62, n)), "part": pa.array([0] * 5000 + [2] * 1000, pa.int32()), "weight": pa.array(np.ones(n)),
                  "labels": pa.array([[v] for v in x[:, 0] + x[:, 1] ** 2]), "features": features})

    def fitted_machine():
        held = trees.Rows(lockstep.rows_held(iter(t.to_batches(max_chunksize=700))))
        tracemalloc.start()
        got = dict(lockstep.drive({0: lambda: kernel.fit(held, 0, kernel.Machine(kind="insensitive", landmarks=200))}))[0]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return got, peak

    in_memory, more = fitted_machine()
    monkeypatch.setattr(lockstep, "HELD_BYTES", 100_000)
    arrow = pa.total_allocated_bytes()
    table = lockstep.rows_held(iter(t.to_batches(max_chunksize=700)))
    assert table.equals(t) and pa.total_allocated_bytes() - arrow < t.nbytes / 4
    in_files, less = fitted_machine()
    assert all(np.array_equal(in_memory[k], in_files[k]) for k in in_memory)
    assert more - less > 5000 * 200 * 8 * 0.9  # the map of the 5000 training rows
