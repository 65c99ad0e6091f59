"""Trees, kernel machines and their fitting in lockstep."""

import functools
import tempfile
import threading
import tracemalloc
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from draftspark.models import fitted, kernel, lockstep, trees
from draftspark.models.cv import TimeSeriesSearch, TimeSeriesSearchModel, time_series_search
from draftspark.models.grids import REFERENCE_GRIDS, growth_of, member_of, points


def table(n=300, columns=12, seed=0):
    """Rows with signs in most columns and a number in the last one, as sparse vectors."""
    rng = np.random.default_rng(seed)
    x = rng.choice([-1.0, 0.0, 0.0, 1.0], (n, columns))
    x[:, -1] = rng.random(n).round(2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + x[:, -1] + rng.normal(0, 0.5, n) > 0.5).astype(float)
    index = [np.flatnonzero(r) for r in x]
    features = pa.StructArray.from_arrays(
        [pa.array([0] * n, pa.int8()), pa.array([columns] * n, pa.int32()), pa.array([i.tolist() for i in index], pa.list_(pa.int32())),
         pa.array([r[i].tolist() for r, i in zip(x, index, strict=True)], pa.list_(pa.float64()))], ["type", "size", "indices", "values"])
    t = pa.table({"key": pa.array(rng.integers(0, 1 << 62, n)), "part": pa.array(np.where(np.arange(n) < n * 3 // 4, 0, 2).astype(np.int32)),
                  "weight": pa.array(rng.random(n) + 0.5), "labels": pa.array([[v, v + a] for v, a in zip(y, x[:, -1], strict=True)]), "features": features})
    return t, x


def one(program):
    return dict(lockstep.drive({0: program}))[0]


def fit(t, how, target=0, stages=(), shards=1):
    def program(r):
        data = yield from trees.binned(r)
        return (yield from trees.fit(data, target, how, stages))

    return in_shards(t, program, shards)


def in_shards(t, program, shards):
    """The program on one shard or on several that exchange their arrays."""
    place = np.asarray(t.column("key")) % shards
    rows = [trees.Rows(t.filter(pa.array(place == s))) for s in range(shards)]
    live = [program(r) for r in rows]
    sent = [next(p) for p in live]
    while True:
        done, nxt = [], []
        for p in live:
            try:
                nxt.append(p.send(sent))
            except StopIteration as end:
                done.append(end.value)
        if done:
            assert len(done) == shards
            return done[0]
        sent = nxt


HOWS = [trees.Growth(rounds=8, leaves=7), trees.Growth(rounds=6, leaves=0, depth=3, min_rows=1, min_hess=1.0, l2=1.0, row_share=0.8, column_share=0.8),
        trees.Growth(rounds=6, loss="squared", l1=0.5), trees.Growth(rounds=5, rate=1.0, leaves=0, depth=6, min_rows=1, min_hess=0.0, split_columns=-1.0, loss="forest")]


@pytest.mark.parametrize("how", HOWS, ids=lambda h: f"{h.loss}-{h.leaves}")
def test_shards_and_stages_give_the_same_model(how):
    """Shards exchange sums only, and a fit of many rounds holds those of fewer."""
    t, _ = table()
    whole = fit(t, how, stages=(3, how.rounds))
    split = fit(t, how, stages=(3, how.rounds), shards=3)
    short = fit(t, replace(how, rounds=3), stages=(3,))
    for a, b in ((whole["trees"], split["trees"]), (whole["trees"][:3], short["trees"])):
        assert [(x["feature"], x["left"], x["right"]) for x in a] == [(x["feature"], x["left"], x["right"]) for x in b]
        assert np.allclose(np.concatenate([x["value"] for x in a]), np.concatenate([x["value"] for x in b]))
    assert np.allclose(whole["stages"], split["stages"]) and whole["stages"][0] == short["stages"][0]


def grown_by_hand(x, y, w, p):
    """First tree of a squared loss, best first, by trying every bound of every column."""
    base = np.dot(w, y) / w.sum()
    g = (base - y) * w

    def score(m):
        s = np.sign(g[m].sum()) * max(abs(g[m].sum()) - p.l1, 0)
        return s * s / (w[m].sum() + p.l2)

    def best(m, depth):
        found = (0.0,)
        if p.depth < 0 or depth < p.depth:
            for c in range(x.shape[1]):
                v = np.unique(np.append(x[:, c], 0.0))
                for bound in ((v[1:] + v[:-1]) / 2):
                    left = m & (x[:, c] <= bound)
                    right = m & ~left
                    if min(left.sum(), right.sum()) >= p.min_rows:
                        gain = round(score(left) + score(right) - score(m), 8)
                        if gain > found[0] + 1e-9:
                            found = (gain, c, bound, left, right, depth)
        return found

    leaves, out = [best(np.ones(len(y), bool), 0)], []
    while len(leaves) < p.leaves:
        i = max(range(len(leaves)), key=lambda i: leaves[i][0])
        gain, *split = leaves[i]
        if not gain:
            break
        c, bound, left, right, depth = split
        out.append((c, round(float(bound), 9)))
        leaves[i:i + 1] = [best(left, depth + 1), best(right, depth + 1)]
    return out


@pytest.mark.parametrize("leaves,depth,l1", [(4, -1, 0.0), (9, -1, 0.0), (9, 3, 0.0), (9, -1, 5.0)])
def test_trees_grow_best_first(leaves, depth, l1):
    t, x = table(120, 6)
    t = t.set_column(1, "part", pa.array(np.zeros(120, np.int32)))
    p = trees.Growth(rounds=1, rate=1.0, leaves=leaves, depth=depth, l1=l1, min_rows=5, loss="squared")
    got = fit(t, p, target=1)["trees"][0]
    want = grown_by_hand(x, np.array(t.column("labels").to_pylist())[:, 1], np.asarray(t.column("weight")), p)
    assert sorted((f, round(b, 9)) for f, b in zip(got["feature"], got["bound"], strict=True) if f >= 0) == sorted(want)


class _Counting:
    """numpy that sums up how many entries its histograms read."""

    def __init__(self):
        self.read = 0

    def __getattr__(self, name):
        return getattr(np, name)

    def bincount(self, x, *rest, **kw):
        self.read += len(x)
        return np.bincount(x, *rest, **kw)


def test_a_split_reads_the_rows_of_its_smaller_side_only(monkeypatch):
    """Steps of 25 rows that double: a tree takes them off one after another."""
    n = 2000
    x = np.arange(n) // 25
    y = 2.0 ** np.minimum(x, 40)
    t, _ = table(n, 3)
    features = pa.StructArray.from_arrays([pa.array([1] * n, pa.int8()), pa.array([None] * n, pa.int32()), pa.array([None] * n, pa.list_(pa.int32())),
                                           pa.array([[float(v) + 1] for v in x], pa.list_(pa.float64()))], ["type", "size", "indices", "values"])
    t = t.set_column(t.schema.get_field_index("features"), "features", features)
    t = t.set_column(t.schema.get_field_index("labels"), "labels", pa.array([[v] for v in y[::-1]]))
    t = t.set_column(t.schema.get_field_index("part"), "part", pa.array(np.zeros(n, np.int32)))
    data = one(lambda: trees.binned(trees.Rows(t)))
    how = trees.Growth(rounds=1, rate=0.1, leaves=31, loss="squared")
    one(lambda: data.narrowed(how.min_rows))
    counting = _Counting()
    monkeypatch.setattr(trees, "np", counting)
    got = one(lambda: trees.fit(data, 0, how))
    assert max(_depths(got["trees"][0])) > 10
    assert counting.read < 25 * n  # 14 times the rows; 44 times when both sides were read


def _depths(tree):
    depth = [0] * len(tree["feature"])
    for i, f in enumerate(tree["feature"]):
        if f >= 0:
            depth[tree["left"][i]] = depth[tree["right"][i]] = depth[i] + 1
    return depth


@pytest.mark.parametrize("how", [trees.Growth(rounds=6, min_rows=5), trees.Growth(rounds=4, leaves=0, depth=8, min_rows=1, min_hess=0.0, rate=1.0, split_columns=-1.0, loss="forest"),
                                 trees.Growth(rounds=6, leaves=0, depth=4, min_rows=1, min_hess=1.0, l2=1.0, row_share=0.8, column_share=0.8)])
def test_few_histograms_at_a_time_give_the_same_model(how, monkeypatch):
    t, _ = table()
    whole = fit(t, how, stages=(2, 4))
    monkeypatch.setattr(trees, "HISTOGRAM_CELLS", 1)
    parts = fit(t, how, stages=(2, 4))
    assert whole["stages"] == parts["stages"]
    for a, b in zip(whole["trees"], parts["trees"], strict=True):
        assert a["feature"] == b["feature"] and a["left"] == b["left"] and np.allclose(a["value"], b["value"])


def test_a_family_equals_separate_fits():
    """Limits that never bind share a fit; those that do get their own."""
    t, _ = table()
    rows = trees.Rows(t)
    data = one(lambda: trees.binned(rows))
    hows = {(n, d): trees.Growth(rounds=4, leaves=n, depth=d) for n in (3, 31, 40) for d in (-1, 2, 10)}
    got = one(lambda: trees.fit_family(data, 0, hows, (2, 4)))
    for name, how in hows.items():
        alone = one(lambda how=how: trees.fit(data, 0, how, (2, 4)))
        assert got[name]["trees"] == alone["trees"] and got[name]["stages"] == alone["stages"]
    assert len({id(x) for x in got.values()}) < len(hows) and got[3, -1]["trees"] != got[31, -1]["trees"] != got[31, 2]["trees"]


def test_long_families_are_split_where_groups_have_none():
    """The 54 points of a grid on three folds: 6 families, but no group of twelve
    has more than twice its share of the models, and each is dealt out once."""
    grid = [growth_of(p, "squared") for p in points(REFERENCE_GRIDS["total_kills"])]
    tasks = [fitted.Task(f, 0, how, (100, 200, 300)) for how in grid if how.rounds == 300 for f in range(3)]
    of = fitted.deal_out(tasks, {0: 2900, 1: 4350, 2: 5800}, 12)
    assert sorted(i for many in of.values() for own in many for i in own) == list(range(54))
    assert max(sum(map(len, many)) for many in of.values()) <= 2 * 54 / 12
    assert len(fitted.deal_out(tasks, {0: 2900, 1: 4350, 2: 5800}, 1)[0]) == 6


@pytest.mark.parametrize("shards", [1, 2])
def test_models_side_by_side_share_their_steps(monkeypatch, shards):
    """Models that differ in target, rate, leaves and columns: side by side they are
    what each is alone, and a run of a step serves many of them."""
    t, _ = table(800)
    hows = [trees.Growth(rounds=5, rate=r, leaves=n, min_rows=5, l1=l1, column_share=s, patience=p, holdout=p / 10)
            for r, n, l1, s, p in ((0.1, 6, 0.0, 1.0, 0), (0.05, 9, 0.0, 0.6, 0), (0.1, 4, 0.1, 1.0, 0), (0.1, 6, 0.0, 1.0, 2))]
    models = [(target, how) for target in (0, 1) for how in hows]
    runs = []

    def counted(kind):
        run = kind.run
        monkeypatch.setattr(kind, "run", staticmethod(lambda steps: runs.append(len(steps)) or run(steps)))

    alone = [fit(t, how, target, (2, 5)) for target, how in models]
    for kind in (trees.Sums, trees.Splits):
        counted(kind)
    place = np.asarray(t.column("key")) % shards
    barrier, sent = threading.Barrier(shards), {}

    def work(shard):
        def exchange(arrays):
            sent[shard] = arrays
            barrier.wait(60)
            every = [sent[i] for i in range(shards)]
            barrier.wait(60)
            return every

        run = functools.partial(lockstep.drive, exchange=exchange if shards > 1 else None, together=len(models))
        data = dict(run({0: lambda: trees.binned(trees.Rows(t.filter(pa.array(place == shard))))}))[0]
        return [got for _, got in run({i: (lambda target=target, how=how: trees.fit(data, target, how, (2, 5), True, True)) for i, (target, how) in enumerate(models)})]

    with ThreadPoolExecutor(shards) as pool:
        got = list(pool.map(work, range(shards)))[0]
    assert sum(runs) > 2 * len(runs)
    for a, b in zip(got, alone, strict=True):
        assert len(a["trees"]) == len(b["trees"]) and np.allclose(a["stages"], b["stages"])
        for x, y in zip(a["trees"], b["trees"], strict=True):
            assert x["feature"] == y["feature"] and x["bound"] == y["bound"] and x["left"] == y["left"]
            assert np.allclose(x["value"], y["value"])


@pytest.mark.parametrize("entries", ["listed", "table"])
def test_rows_move_alike_by_marks_and_by_entries(entries):
    """A split's rows are found in the lists of its cells or, where these are long, in the rows' entries."""
    t, _ = table()
    data = one(lambda: trees.binned(trees.Rows(t)))
    how = trees.Growth(rounds=4, leaves=12, min_rows=3)
    want = one(lambda: trees.fit(data, 0, how))["trees"]
    narrow = one(lambda: data.narrowed(3))
    if entries == "listed":
        narrow.listed_from = narrow.listed_from.copy()
        narrow.table = np.concatenate([narrow.table, np.full((200, 300), narrow.cells, np.int32)])  # entries cost more now
    else:
        narrow.listed_from = narrow.listed_from * 10_000
    assert one(lambda: trees.fit(data, 0, how))["trees"] == want


@pytest.mark.parametrize("shards", [1, 3])
def test_rows_that_keep_their_leaf_are_not_read(shards):
    """Columns that few rows have, and one of many values: a split of such a column
    names its few rows only, and the trees are those of rows that are listed by node."""
    rng = np.random.default_rng(4)
    n, columns = 3000, 60
    x = np.zeros((n, columns))
    x[np.arange(n), rng.integers(0, columns - 1, n)] = rng.choice([-1.0, 1.0], n)
    x[:, -1] = rng.normal(size=n).round(2)
    t, _ = table(n)
    features = pa.StructArray.from_arrays([pa.array([1] * n, pa.int8()), pa.array([None] * n, pa.int32()), pa.array([None] * n, pa.list_(pa.int32())),
                                           pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * columns, pa.int32()), pa.array(x.ravel()))], ["type", "size", "indices", "values"])
    t = t.set_column(t.schema.get_field_index("features"), "features", features)
    t = t.set_column(t.schema.get_field_index("labels"), "labels", pa.array([[float(v)] for v in x @ rng.normal(size=columns) + rng.normal(size=n) > 0]))

    def program(joint, p):
        def run(r):
            data = yield from trees.binned(r)
            g, h, c = (0.5 - r.label(0)) * r.train, 0.25 * r.train, r.train.astype(float)
            narrow = yield from data.narrowed(p.min_rows)
            steps = trees.grow(narrow, g, h, c, p, 0, set(), joint)
            answer = None
            while True:
                try:
                    asked = steps.send(answer)
                except StopIteration as end:
                    return *end.value, read
                if isinstance(asked, trees.Sums):
                    read.extend(len(i) for i in asked.inside if i is not None)
                answer = asked.run([asked])[0] if isinstance(asked, trees.Joint) else (yield asked)
        read = []
        return run

    how = trees.Growth(leaves=24, min_rows=8)
    one_tree, step, read = in_shards(t, program(True, how), shards)
    want, expected, _ = in_shards(t, program(False, how), shards)
    assert one_tree["feature"] == want["feature"] and one_tree["bound"] == want["bound"] and one_tree["left"] == want["left"]
    assert np.allclose(one_tree["value"], want["value"]) and np.allclose(step, expected)
    assert max(_depths(one_tree)) > 6 and sum(read) < 4 * n


def test_scores_follow_the_rows_of_the_fit():
    t, x = table()
    for how in HOWS:
        got = fit(t, how, stages=(how.rounds,))
        p = trees.Scorer(got["base"], got["trees"], how.loss)(x)
        test, y = np.asarray(t.column("part")) == 2, np.array(t.column("labels").to_pylist())[:, 0]
        want = np.abs(p - y)[test].sum() if how.loss == "squared" else ((p > 0.5) == (y > 0.5))[test].sum()
        assert np.isclose(got["stages"][0][1], want)


def test_early_end_keeps_the_rounds_before_it():
    t, _ = table()
    got = fit(t, trees.Growth(rounds=400, rate=0.3, patience=5, holdout=0.2))
    assert 5 < len(got["trees"]) < 400


def test_reference_grids_are_distinct_fits():
    """Every point of the grids is a model of its own (L1, leaf and depth limits included)."""
    for name, size in (("winner", 32), ("ultimate", 16), ("kills", 8), ("minutes", 16), ("turrets", 16), ("total_kills", 54)):
        assert len({growth_of(p, "logistic") for p in points(REFERENCE_GRIDS[name])}) == size
    assert len(points(REFERENCE_GRIDS["ensemble"])) == 128
    assert member_of("hgb", {"hgb__learning_rate": 0.15, "hgb__max_depth": None}) == trees.Growth(rounds=500, rate=0.15, leaves=31, l2=0.5, patience=10, holdout=0.1)


# --- kernel machines -----------------------------------------------------------

def exact_machine(k, y, c, steps=20_000):
    """Decision values of the exact dual solution, by the most violating pairs."""
    a, g = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(steps):
        up = ((y > 0) & (a < c - 1e-12)) | ((y < 0) & (a > 1e-12))
        low = ((y > 0) & (a > 1e-12)) | ((y < 0) & (a < c - 1e-12))
        i, j = np.flatnonzero(up)[np.argmax((-y * g)[up])], np.flatnonzero(low)[np.argmin((-y * g)[low])]
        gap = (-y * g)[i] - (-y * g)[j]
        if gap < 1e-6:
            break
        d = min(gap / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), c - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c - a[j])
        a[i] += y[i] * d
        a[j] -= y[j] * d
        g += y * (k[:, i] - k[:, j]) * d
    return (a * y) @ k + ((-y * g)[i] + (-y * g)[j]) / 2


@pytest.mark.parametrize("c", [1.0, 10.0])
def test_hinge_machine_is_close_to_the_exact_kernel(c):
    t, x = table(160)
    rows = trees.Rows(t)
    got = one(lambda: kernel.fit(rows, 0, kernel.Machine(c=c)))
    train = rows.train
    k = kernel.kernel(x[train], x[train], got["gamma"])
    want = exact_machine(k, np.where(rows.label(0)[train] > 0.5, 1.0, -1.0), c)
    assert np.isclose(got["gamma"], 1 / (x.shape[1] * x[train].var()))
    assert np.abs(kernel.KernelScorer(got, False)(x[train]) - want).max() < 0.01


def test_insensitive_machine_meets_the_optimality_conditions():
    """No small change of the fitted function lowers the exact objective."""
    t, x = table(120)
    rows = trees.Rows(t)
    m = kernel.Machine(kind="insensitive", c=1.0, epsilon=0.1)
    got = one(lambda: kernel.fit(rows, 1, m))
    train, y = rows.train, rows.label(1)[rows.train]
    k = kernel.kernel(x[train], got["landmarks"], got["gamma"])
    kk = kernel.kernel(got["landmarks"], got["landmarks"], got["gamma"])

    def objective(alpha, bias):
        return alpha @ kk @ alpha / 2 + np.maximum(np.abs(y - k @ alpha - bias) - m.epsilon, 0).sum() * m.c

    base = objective(got["alpha"], got["bias"])
    rng = np.random.default_rng(0)
    for size in (1e-3, 1e-2, 0.1):
        for _ in range(50):
            assert objective(got["alpha"] + rng.normal(0, size, len(got["alpha"])), got["bias"] + rng.normal(0, size)) > base - 2e-3 * abs(base)


def test_a_machine_holds_its_map_once_and_works_on_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    n, width, landmarks = 12_000, 60, 100
    x = rng.normal(size=(n, width))
    features = pa.StructArray.from_arrays([pa.array([1] * n, pa.int8()), pa.array([None] * n, pa.int32()), pa.array([None] * n, pa.list_(pa.int32())),
                                           pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(x.ravel()))], ["type", "size", "indices", "values"])
    t = pa.table({"key": pa.array(np.arange(n)), "part": pa.array(np.where(np.arange(n) % 5 == 0, 2, 0).astype(np.int32)), "weight": pa.array(np.ones(n)),
                  "labels": pa.array((x[:, :1] * 3 + x[:, 1:2]).tolist()), "features": features})
    how = kernel.Machine(kind="insensitive", landmarks=landmarks)
    tracemalloc.start()
    whole = one(lambda: kernel.fit(trees.Rows(t), 0, how))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * n * (landmarks + 1) * 8
    monkeypatch.setattr(kernel, "_BLOCK", 701)
    parts = one(lambda: kernel.fit(trees.Rows(t), 0, how))
    assert np.array_equal(whole["landmarks"], parts["landmarks"])
    scored = [kernel.KernelScorer(m, False)(x[:500]) for m in (whole, parts)]
    assert np.allclose(*scored, atol=1e-3)


def test_few_landmarks_come_close_and_shards_agree():
    t, x = table(300, 5)
    rows = trees.Rows(t)
    full = one(lambda: kernel.fit(rows, 0, kernel.Machine(probability=True)))
    few = one(lambda: kernel.fit(rows, 0, kernel.Machine(landmarks=60, probability=True)))
    a, b = kernel.KernelScorer(full, True)(x), kernel.KernelScorer(few, True)(x)
    assert ((a > 0) & (a < 1)).all() and np.corrcoef(a, b)[0, 1] > 0.97
    split = in_shards(t, lambda r: kernel.fit(r, 0, kernel.Machine(landmarks=60, probability=True)), 3)
    assert np.allclose(kernel.KernelScorer(split, True)(x), b, atol=1e-3)
    y = rows.label(0)
    assert a[y > 0.5].mean() > a[y < 0.5].mean() + 0.2


# --- on Spark --------------------------------------------------------------------

@pytest.fixture(scope="module")
def rows(spark):
    t, x = table(200, 6)
    data = [(f"g{i}", i, 1.0, float(r["labels"][0]), float(r["labels"][1]), Vectors.dense(v)) for i, (r, v) in enumerate(zip(t.to_pylist(), x.tolist(), strict=True))]
    return spark.createDataFrame(data, ["gameid", "ordinal", "weight", "result", "total", "raw"])


def models(rows, tasks):
    part = F.when(F.col("ordinal") < 150, fitted.TRAIN).otherwise(fitted.TEST)
    many = fitted.training_rows(rows.withColumnRenamed("raw", "features"), 0, "gameid", ["result", "total"], part, "weight")
    many = many.unionByName(many.where("part = 0").withColumn("fold", F.lit(1)))
    found = fitted.fit_many(many, tasks)
    stages = sorted((r["task"], r["stage"], round(r["measure"], 6), r["n"]) for r in found.where("stage IS NOT NULL").collect())
    out = rows.withColumnRenamed("raw", "features")
    said = [[r[0] for r in m.transform(out).orderBy("ordinal").select(vector_to_array("probability")[1] if m.classifies else "prediction").collect()]
            for m in fitted.models_of(found, tasks) if m]
    return stages, said, found.where("key IS NOT NULL").count()


def test_many_models_in_one_stage(rows):
    tasks = [fitted.Task(0, 0, trees.Growth(rounds=5, leaves=5), (2, 5), keep=True), fitted.Task(0, 1, trees.Growth(rounds=4, loss="squared"), (4,), keep=True),
             fitted.Task(1, 0, trees.Growth(rounds=3), keep=True), fitted.Task(0, 0, kernel.Machine(probability=True), keep=True, predict=True)]
    stages, said, n = models(rows, tasks)
    assert [s[:2] for s in stages] == [(0, 2), (0, 5), (1, 4)] and n == 50 and all(len(x) == 200 for x in said)
    alone = models(rows, [replace(tasks[0], stages=(5,))])
    assert alone[0][0][2:] == stages[1][2:] and alone[1][0] == said[0]


def test_barrier_stage_equals_one_shard(rows, monkeypatch):
    """A stage of three tasks that exchange histograms (each exchange takes Spark
    about a second, so the models are very small)."""
    tasks = [fitted.Task(0, 0, trees.Growth(rounds=2, leaves=3), (1, 2), keep=True), fitted.Task(0, 1, trees.Growth(rounds=1, loss="squared", leaves=2), (1,))]
    one_shard = models(rows, tasks)
    monkeypatch.setattr(lockstep, "SHARD_ROWS", 120)
    three = models(rows, tasks)
    assert one_shard[0] == three[0] and np.allclose(one_shard[1], three[1])


def test_search_scores_equal_separate_fits(rows):
    stages = [VectorAssembler(inputCols=["raw"], outputCol="features")]
    grid = {"n_estimators": [2, 5], "learning_rate": [0.1, 0.3], "num_leaves": [4]}
    model, avg, per_fold, best = time_series_search(rows, stages, {"result": "logistic"}, grid, 2)["result"]
    for i, point in enumerate(points(grid)):
        alone = time_series_search(rows, stages, {"result": "logistic"}, {k: [v] for k, v in point.items()}, 2)["result"]
        assert alone[2] == [[m[i]] for m in per_fold]
    assert avg[best] == max(avg) and best == avg.index(max(avg))
    assert model.transform(rows).where("prediction = result").count() > 120


def test_search_is_a_stage_of_a_pipeline(spark, rows):
    search = TimeSeriesSearch([VectorAssembler(inputCols=["raw"], outputCol="features")], folds=2, grid={"n_estimators": [2, 3]})
    base = tempfile.mkdtemp(prefix="ds-search-")
    search.write().overwrite().save(f"{base}/search")
    again = TimeSeriesSearch.load(f"{base}/search")
    assert again.uid == search.uid and again._p("grid") == search._p("grid") and len(again.stages) == 1
    assert search.copy({search.folds: 3})._p("folds") == 3 and search._p("folds") == 2
    fitted_ = Pipeline(stages=[again]).fit(rows)
    assert isinstance(fitted_, PipelineModel) and isinstance(fitted_.stages[0], TimeSeriesSearchModel)
    fitted_.write().overwrite().save(f"{base}/model")
    loaded = PipelineModel.load(f"{base}/model")
    a, b = ([r.prediction for r in m.transform(rows).orderBy("ordinal").collect()] for m in (fitted_, loaded))
    assert a == b and loaded.stages[0].avgMetrics == fitted_.stages[0].avgMetrics
    assert loaded.stages[0].scores(spark, "t").count() == 4
