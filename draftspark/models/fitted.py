"""Fitting many tree models and kernel machines in one Spark stage, and the fitted models.

``training_rows`` is the one input: rows of several folds, each transformed by the
feature stages of its fold.  ``fit_many`` runs all models over them in lockstep
(``lockstep``); what reaches the driver is the models themselves, bounded by rounds
times leaves, and the scores.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..jvm import fits
from ..session import in_session, reachable, written
from .kernel import KernelScorer, Machine
from .kernel import fit as fit_machine
from .lockstep import WAVE, in_lockstep, shards_for
from .persist import StatePersistence
from .trees import Growth, Rows, Scorer, binned, fit_family

TRAIN, VALID, TEST = 0, 1, 2
#: Rows of a fold up to which a task holds it whole and trees are grown in its JVM (some 300 bytes each).
WHOLE_ROWS = 1_000_000
#: So many rows more would double the time of a tree of few rows: what a level costs without any.
LEVEL_ROWS = 15_000
#: Rows that models side by side hold in all (some 100 bytes each), and the most leaves of such a model.
TOGETHER_ROWS, FEW_LEAVES = 400_000, 64


@dataclass(frozen=True)
class Task:
    """One model to fit: on which fold and target, how, the round counts to be
    scored on the test rows, whether the model itself or its test scores are wanted."""

    fold: int
    target: int
    how: Growth | Machine
    stages: tuple[int, ...] = ()
    keep: bool = False
    predict: bool = False


def training_rows(df: DataFrame, fold: int, key: str, labels: list[str], part: Column | int = TRAIN, weight: str | None = None) -> DataFrame:
    """Rows of one fold from its transformed match rows (with ``features``)."""
    part = part if isinstance(part, Column) else F.lit(part)
    return df.select(F.lit(fold).alias("fold"), F.xxhash64(key).alias("key"), part.cast("int").alias("part"),
                     (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"), F.array(*[F.col(c).cast("double") for c in labels]).alias("labels"), "features")


_SCHEMA = ("task int, base double, stage int, measure double, n long, tree int, nodes struct<feature:array<int>,bound:array<double>,left:array<int>,right:array<int>,value:array<double>>, "
           "machine string, key long, score double")


_GROWTH = ("rounds", "rate", "leaves", "depth", "min_rows", "min_hess", "l1", "l2", "row_share", "column_share", "split_columns", "loss", "patience", "holdout", "seed")


def few_leaves(how: Growth | Machine) -> bool:
    """Whether trees are so small that many can be grown side by side."""
    return isinstance(how, Growth) and (0 < how.leaves <= FEW_LEAVES or 0 <= how.depth and 1 << how.depth <= FEW_LEAVES)


def deal_out(tasks: list[Task], sizes: dict[int, int], groups: int) -> dict[int, list[tuple[int, ...]]]:
    """Families of tasks (places in the list) for each group.  Trees that differ in
    their limits only are one family, as they may share fits; one that costs more
    than a group's share is split, by leaves and then by depth, so that no group
    fits the models of a long family one after another while others have none."""
    families: dict = {}
    for i, t in enumerate(tasks):
        alike = replace(t.how, leaves=0, depth=-1) if isinstance(t.how, Growth) else i
        families.setdefault((t.fold, t.target, alike, t.stages, t.keep, t.predict), []).append(i)

    def cost(own: list[int]) -> int:
        t = tasks[own[0]]
        return (sizes.get(t.fold, 0) + LEVEL_ROWS) * (t.how.rounds * len({(tasks[i].how.leaves, tasks[i].how.depth) for i in own}) if isinstance(t.how, Growth) else 500)

    units = list(families.values())
    share = sum(map(cost, units)) / groups
    for limit in ("leaves", "depth"):
        parts: list[list[int]] = []
        for own in units:
            if cost(own) <= share or not isinstance(tasks[own[0]].how, Growth):
                parts.append(own)
                continue
            by: dict = {}
            for i in own:
                by.setdefault(getattr(tasks[i].how, limit), []).append(i)
            parts += by.values()
        units = parts
    load, of = [0] * groups, {}
    for own in sorted(units, key=lambda own: -cost(own)):  # the costliest first, each to the least loaded group
        g = min(range(groups), key=load.__getitem__)
        of.setdefault(g, []).append(tuple(own))
        load[g] += cost(own)
    return of


def fit_many(rows: DataFrame, tasks: list[Task]) -> DataFrame:
    """Results by ``task`` (place in the list), written: rows of a stage (measure,
    n), of a tree (tree, nodes, base), of a kernel machine (JSON), of a test row
    (key, score)."""
    sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}  # one row a fold
    whole = max(sizes.values(), default=0) <= WHOLE_ROWS
    own = [i for i, t in enumerate(tasks) if whole and isinstance(t.how, Growth)]
    parts = [(_fit_trees, own), (_fit_in_lockstep, [i for i in range(len(tasks)) if i not in set(own)])]
    parts = [(fit, places) for fit, places in parts if places]
    with ThreadPoolExecutor(len(parts) or 1) as pool:
        found = list(pool.map(in_session(rows.sparkSession, lambda x: x[0](rows, {i: tasks[i] for i in x[1]}, sizes)), parts))
    if not found:
        return written(rows.sparkSession.createDataFrame([], _SCHEMA), "fitted")
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _to_groups(rows: DataFrame, tasks: list[Task], of: dict[int, list[tuple[int, ...]]]) -> DataFrame:
    """The rows of each group's folds, with ``group``."""
    needs = {f: sorted(g for g, many in of.items() if any(tasks[own[0]].fold == f for own in many)) for f in {t.fold for t in tasks}}
    where = F.create_map(*[x for f, gs in sorted(needs.items()) for x in (F.lit(f), F.array(*map(F.lit, gs)))])
    return rows.where(F.col("fold").isin(sorted(needs))).withColumn("group", F.explode(where[F.col("fold")]))


def _fit_trees(rows: DataFrame, of_place: dict[int, Task], sizes: dict[int, int]) -> DataFrame:
    """Trees on folds that a task holds whole: each group's families one after another, in the JVM."""
    places, tasks = list(of_place), list(of_place.values())
    groups = max(1, min(len(tasks), rows.sparkSession.sparkContext.defaultParallelism))
    of = deal_out(tasks, sizes, groups)
    lines = []
    for g, many in of.items():
        for own in sorted(many, key=lambda own: tasks[own[0]].fold):
            t = tasks[own[0]]
            members = ";".join(":".join(str(x) for x in (places[i], *(getattr(tasks[i].how, f) for f in _GROWTH))) for i in own)
            lines.append("\t".join([str(g), str(t.fold), str(t.target), ",".join(map(str, sorted(set(t.stages)))), str(int(t.keep)), str(int(t.predict)), members]))
    dealt = _to_groups(rows, tasks, of).repartitionById(groups, F.col("group")).sortWithinPartitions("fold")
    return written(fits(dealt.select("fold", "key", "part", "weight", "labels", "features"), "\n".join(lines), _SCHEMA), "fitted")


def _fit_in_lockstep(rows: DataFrame, of_place: dict[int, Task], sizes: dict[int, int]) -> DataFrame:
    """Kernel machines, and trees on folds that no task holds whole."""
    spark = rows.sparkSession
    reachable(spark)
    places, tasks = list(of_place), list(of_place.values())
    shards = shards_for(rows, max(sizes.values(), default=1))
    groups = 1 if shards > 1 else max(1, min(len(tasks), spark.sparkContext.defaultParallelism))
    of = deal_out(tasks, sizes, groups)
    dealt = _to_groups(rows, tasks, of)

    def work(table: pa.Table | None, group: int, drive, shard: int) -> Iterator[dict]:
        many = of.get(group, [])
        folds = sorted({tasks[own[0]].fold for own in many})
        fold = np.asarray(table.column("fold")) if table is not None else np.zeros(0, np.int32)
        data = {f: Rows((table if (fold == f).all() else table.filter(pa.array(fold == f))) if len(fold) else None) for f in folds}
        grown = sorted({tasks[own[0]].fold for own in many if isinstance(tasks[own[0]].how, Growth)})
        bins = dict(drive({f: (lambda f=f: binned(data[f])) for f in grown}))

        def program(own: tuple):
            t = tasks[own[0]]
            if isinstance(t.how, Machine):
                return lambda: fit_machine(data[t.fold], t.target, t.how)
            return lambda: fit_family(bins[t.fold], t.target, {i: tasks[i].how for i in own}, t.stages, t.keep or t.predict, few_leaves(t.how))

        small = [own for own in many if few_leaves(tasks[own[0]].how)]
        small.sort(key=lambda own: (tasks[own[0]].fold, own))
        most = max((data[tasks[own[0]].fold].n for own in small), default=0)
        side_by_side = drive({own: program(own) for own in small}, max(1, min(WAVE, TOGETHER_ROWS // max(most, 1))))
        alone = drive({own: program(own) for own in sorted(set(many) - set(small))})
        results = ((i, got[i] if isinstance(tasks[i].how, Growth) else got) for own, got in chain(side_by_side, alone) for i in own)
        for i, got in results:
            t, rows_ = tasks[i], data[tasks[i].fold]
            if t.predict:
                width = bins[t.fold].width if t.fold in bins else rows_.width
                for a in range(0, int(rows_.test.sum()), 4096):
                    at = np.flatnonzero(rows_.test)[a:a + 4096]
                    x = _dense_at(rows_, at, width)
                    yield from ({"task": places[i], "key": k, "score": s} for k, s in zip(rows_.key[at].view(np.int64).tolist(), scorer_of(t.how, got)(x).tolist(), strict=True))
            if shard:
                continue
            if isinstance(t.how, Machine):
                if t.keep:
                    yield {"task": places[i], "machine": json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in got.items()})}
                continue
            yield from ({"task": places[i], "base": got["base"], "stage": s, "measure": m, "n": int(n)} for s, m, n in got["stages"])
            if t.keep:
                yield from ({"task": places[i], "base": got["base"], "tree": k, "nodes": tree} for k, tree in enumerate(got["trees"]))
                if not got["trees"]:
                    yield {"task": places[i], "base": got["base"]}

    return written(in_lockstep(dealt, work, _SCHEMA, groups, shards), "fitted")


def _dense_at(rows: Rows, at: np.ndarray, width: int) -> np.ndarray:
    place = np.full(rows.n, -1)
    place[at] = np.arange(len(at))
    inside = place[rows.row] >= 0
    x = np.zeros((len(at), max(width, rows.width)))
    x[place[rows.row[inside]], rows.column[inside]] = rows.value[inside]
    return x


def scorer_of(how: Growth | Machine, got: dict):
    if isinstance(how, Machine):
        return KernelScorer(got, how.probability)
    return Scorer(got["base"], got["trees"], how.loss)


def scores(columns: Column | str, scorers: list) -> Column:
    """array<double>: the score of each scorer for a dense array column, all in
    one pass over Arrow batches."""

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        n = len(x)
        flat = np.asarray(x.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 0))
        out = np.column_stack([s(flat) for s in scorers]) if n else np.zeros((0, len(scorers)))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(scorers), pa.int32()), pa.array(out.ravel()))

    return run(F.col(columns) if isinstance(columns, str) else columns)


class FittedModel(Model, StatePersistence):
    """A fitted model: adds ``prediction``, and ``probability`` if it is a classifier."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "output", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "output", TypeConverters.toString)

    def __init__(self, how: Growth | Machine | None = None, found: DataFrame | None = None):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction", probabilityCol="probability")
        self._scorer, self._state, self._scalars = None, {}, {}
        if how is not None:
            self._scalars = {"kind": type(how).__name__, "how": asdict(how)}
            self._state = {"model": found}

    def getFeaturesCol(self) -> str:
        return self.getOrDefault(self.featuresCol)

    @property
    def classifies(self) -> bool:
        how = self._scalars["how"]
        return how.get("loss", "logistic") != "squared" and how.get("kind", "hinge") == "hinge"

    @property
    def scorer(self):
        """Read once; a model is as large as its rounds and leaves, not the data."""
        if self._scorer is None:
            how = {"Growth": Growth, "Machine": Machine}[self._scalars["kind"]](**self._scalars["how"])
            found = self._state["model"].where("stage IS NULL AND key IS NULL").collect()
            if isinstance(how, Machine):
                got = json.loads(found[0]["machine"])
                got = {k: np.array(v) if isinstance(v, list) else v for k, v in got.items()}
            else:
                trees = sorted((r["tree"], r["nodes"].asDict()) for r in found if r["tree"] is not None)
                got = {"base": found[0]["base"], "trees": [t for _, t in trees]}
            self._scorer = scorer_of(how, got)
        return self._scorer

    def _transform(self, df: DataFrame) -> DataFrame:
        reachable(df.sparkSession)
        value = scores(vector_to_array(F.col(self.getFeaturesCol())), [self.scorer])[0]
        out = df.withColumn("_score", value)
        if self.classifies:
            out = (out.withColumn(self.getOrDefault(self.probabilityCol), array_to_vector(F.array(F.lit(1.0) - F.col("_score"), F.col("_score"))))
                   .withColumn(self.getOrDefault(self.predictionCol), (F.col("_score") > 0.5).cast("double")))
        else:
            out = out.withColumn(self.getOrDefault(self.predictionCol), F.col("_score"))
        return out.drop("_score")


def models_of(found: DataFrame, tasks: list[Task]) -> list[FittedModel]:
    """The models of the tasks that keep theirs, None for others."""
    out = []
    for i, t in enumerate(tasks):
        out.append(FittedModel(t.how, found.where(F.col("task") == i)) if t.keep else None)
    return out
