"""Nearest neighbours by inner product with a vantage-point tree per shard.

Vectors get one more component, ``sqrt(M^2 - |x|^2)`` with M the largest norm of
the table, and queries a zero: the largest inner products are then the smallest
Euclidean distances, for which the triangle inequality holds.  Vectors are dealt
to shards of a bounded size; a shard stores its distinct vectors in the order of
a vantage-point tree whose nodes keep the range of distances from the vantage
point on either side.  Queries come to every shard in blocks; a block descends
together, nearer side first, and a query skips a side if ``factor`` times the
distance to that side's range exceeds its current k-th distance.  Factor one is
exact; a larger factor prunes more.

A vector that many rows share is stored once with the k + 1 smallest ids, the
only ones that any answer can name.  The k best points of a shard are those by
score, then by the smallest id that they can give to the query; scores that may
be among them are summed anew in one order, as products of whole matrices differ
in the last bits and would part ties.

Defined results: vectors that are null, zero or hold null or non-finite
components take no part, as query or candidate; only vectors of the same length
meet; rows with the query's own id are not its candidates; fewer candidates than
k are all returned; ties go to the smaller id; a null id takes no part; repeated
rows count once; an id with several vectors of a length has, as query or
candidate, the best score of any of them.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K

TOP = 20
SHARD = 8192             # vectors of a shard
BLOCK = 8192             # queries of a block
LEAF = 512               # vectors of a leaf
FACTOR = 1.0             # relaxation of the pruning; 1 is exact
_SLACK = 1e-6            # for rounding of distances, relative to the longest possible one if that is over 1
_ROWS = 1024             # queries that meet a leaf at a time
_NO_ID = np.iinfo(np.int64).max


# --- the tree of one shard -----------------------------------------------------

def build_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the points, links, ranges) of a tree over augmented points.
    Link rows: vantage point (a place in the order), inner child, outer child,
    first and last place of the node; a leaf has no children (-1).  Range rows:
    lowest and highest distance from the vantage point on either side."""
    order = np.arange(len(points))
    links, ranges, work = [], [], [(0, len(points), -1, 0)]
    vantage = []
    while work:
        a, b, parent, side = work.pop()
        node = len(links)
        links.append([-1, -1, -1, a, b])
        ranges.append([0.0, 0.0, 0.0, 0.0])
        vantage.append(-1)
        if parent >= 0:
            links[parent][1 + side] = node
        if b - a <= LEAF:
            continue
        own = points[order[a:b]]
        far = int(((own - own.mean(0)) ** 2).sum(1).argmax())
        distance = np.sqrt(((own - own[far]) ** 2).sum(1))
        vantage[node] = order[a + far]
        by = np.argsort(distance, kind="stable")
        order[a:b], distance = order[a:b][by], distance[by]
        half = (b - a) // 2
        ranges[node] = [distance[0], distance[half - 1], distance[half], distance[-1]]
        work += [(a + half, b, node, 1), (a, a + half, node, 0)]
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    links = np.array(links, np.int64).reshape(-1, 5)
    links[:, 0] = [place[v] if v >= 0 else -1 for v in vantage]
    return order, links, np.array(ranges).reshape(-1, 4)


class Tree:
    def __init__(self, vectors: np.ndarray, links: np.ndarray, ranges: np.ndarray, top: float, factor: float,
                 ids: np.ndarray | None = None, next_ids: np.ndarray | None = None):
        """vectors: in tree order, not augmented; top: M squared; ids and
        next_ids: the smallest two ids of each point, by default its place."""
        self.x, self.links, self.ranges, self.top, self.factor = vectors, links, ranges, top, factor
        self.ids = np.arange(len(vectors)) if ids is None else ids
        self.next_ids = self.ids if next_ids is None else next_ids

    def search(self, queries: np.ndarray, k: int, not_place: np.ndarray, query_ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places (-1: none) of the k best points of each query, of
        equal ones those with the smaller id but for the query's own;
        ``not_place`` is a point to leave out, or -1."""
        self.q, self.k, self.skip, self.query_ids = queries, k, not_place, query_ids
        self.norm = (queries ** 2).sum(1)
        self.slack = _SLACK * np.sqrt(np.maximum(self.norm + self.top, 1))
        self.rounding = 4 * np.finfo(float).eps * self.x.shape[1] * np.sqrt(self.norm * self.top)  # of a score
        self.score = np.full((len(queries), k), -np.inf)
        self.id = np.full((len(queries), k), _NO_ID)
        self.place = np.full((len(queries), k), -1, np.int64)
        self.visited = 0
        if len(self.links) and len(self.x):
            self._visit(0, np.arange(len(queries)))
        return self.score, self.place

    def _reach(self, rows: np.ndarray) -> np.ndarray:
        """Distance of the k-th best point so far."""
        low = self.score[rows, -1]
        return np.sqrt(np.maximum(self.norm[rows] + self.top - 2 * low, 0))

    def _visit(self, node: int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        vantage, inner, outer, a, b = self.links[node]
        if inner < 0:
            for i in range(0, len(rows), _ROWS):
                self._leaf(int(a), int(b), rows[i:i + _ROWS])
            return
        d = np.sqrt(np.maximum(self.norm[rows] + self.top - 2 * (self.q[rows] @ self.x[vantage]), 0))
        low_in, high_in, low_out, high_out = self.ranges[node]
        gap_in = np.maximum(np.maximum(d - high_in, low_in - d), 0)
        gap_out = np.maximum(np.maximum(d - high_out, low_out - d), 0)
        first = gap_in <= gap_out
        for side, own, gap in ((inner, first, gap_in), (outer, ~first, gap_out), (outer, first, gap_out), (inner, ~first, gap_in)):
            mine = rows[own]
            self._visit(int(side), mine[self.factor * gap[own] <= self._reach(mine) + self.slack[mine]])

    def _leaf(self, a: int, b: int, rows: np.ndarray) -> None:
        self.visited += len(rows) * (b - a)
        score = self.q[rows] @ self.x[a:b].T
        out = np.flatnonzero((self.skip[rows] >= a) & (self.skip[rows] < b))
        score[out, self.skip[rows[out]] - a] = -np.inf
        near = np.flatnonzero(score.max(1) >= self.score[rows, -1] - self.rounding[rows])
        rows, score = rows[near], score[near]
        low = self.score[rows, -1]
        if self.k < b - a:
            low = np.maximum(low, -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1])
        row, place = np.nonzero((score >= (low - 2 * self.rounding[rows])[:, None]) & (score > -np.inf))
        place += a
        ids = self.ids[place]
        if self.query_ids is not None:
            own = ids == self.query_ids[rows[row]]
            ids = np.where(own, self.next_ids[place], ids)
            fit = ~own | (ids != _NO_ID)
            row, place, ids = row[fit], place[fit], ids[fit]
        exact, step = np.empty(len(row)), max(1, (1 << 20) // self.x.shape[1])
        for i in range(0, len(row), step):
            part = slice(i, i + step)
            exact[part] = (self.q[rows[row[part]]] * self.x[place[part]]).sum(1)
        last, last_id = self.score[rows[row], -1], self.id[rows[row], -1]
        fit = (exact > last) | (exact == last) & (ids < last_id)
        row, place, ids, exact = row[fit], place[fit], ids[fit], exact[fit]
        if not len(row):
            return
        changed, row = np.unique(row, return_inverse=True)
        rows, n = rows[changed], len(changed)
        row = np.concatenate([np.repeat(np.arange(n), self.k), row])
        exact, ids, place = (np.concatenate([old[rows].ravel(), new]) for old, new in ((self.score, exact), (self.id, ids), (self.place, place)))
        by = np.lexsort((ids, -exact, row))
        best = by[np.arange(len(by)) - np.searchsorted(row[by], np.arange(n))[row[by]] < self.k].reshape(n, self.k)
        self.score[rows], self.id[rows], self.place[rows] = exact[best], ids[best], place[best]


# --- the distributed index -------------------------------------------------------

def usable(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(vec_id, v array<double>, dim, norm2) of the vectors that take part, repeated rows once."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return v.where(fine).distinct().select("vec_id", "v", F.size("v").alias("dim"), norm.alias("norm2")).where("norm2 > 0")


def build_index(vectors: DataFrame, top: int = TOP) -> DataFrame:
    """One row per shard of ``usable`` vectors joined to ``sizes``: dim, shard,
    top (M squared), vectors and their ids in tree order, and the tree."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        x, one = np.unique(np.stack(group["v"].to_numpy()), axis=0, return_inverse=True)
        ids, one = group["vec_id"].to_numpy(np.int64), one.ravel()
        by = np.argsort(one, kind="stable")
        ids, one = ids[by], one[by]
        rank = np.arange(len(one)) - np.searchsorted(one, one)
        ids, one = ids[rank <= top], one[rank <= top]
        high = float(group["high"].iloc[0])
        last = np.sqrt(np.maximum(high - (x ** 2).sum(1), 0))
        order, links, ranges = build_tree(np.concatenate([x, last[:, None]], 1))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return pd.DataFrame([{"dim": int(group["dim"].iloc[0]), "shard": int(group["shard"].iloc[0]), "high": high, "vectors": K.pack(x[order]),
                              "ids": K.pack(ids), "places": K.pack(place[one]), "links": K.pack(links), "ranges": K.pack(ranges)}])

    return vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards"))).groupBy("dim", "shard").applyInPandas(
        build, "dim int, shard long, high double, vectors binary, ids binary, places binary, links binary, ranges binary")


def search_shard(block: pd.Series, index: pd.Series, k: int, factor: float) -> pd.DataFrame:
    """The k best candidates of a shard for each query of a block."""
    dim = int(index["dim"])
    x = np.frombuffer(index["vectors"]).reshape(-1, dim)
    ids, places = np.frombuffer(index["ids"], np.int64), np.frombuffer(index["places"], np.int64)
    queries, query_ids = np.frombuffer(block["vectors"]).reshape(-1, dim), np.frombuffer(block["ids"], np.int64)
    by_place = np.argsort(places, kind="stable")
    heads = np.searchsorted(places[by_place], np.arange(len(x) + 1))
    lone = np.diff(heads) == 1
    first, second = ids[by_place[heads[:-1]]], np.where(lone, _NO_ID, ids[by_place[np.minimum(heads[:-1] + 1, len(ids) - 1)]])
    tree = Tree(x, np.frombuffer(index["links"], np.int64).reshape(-1, 5), np.frombuffer(index["ranges"]).reshape(-1, 4), float(index["high"]), factor, first, second)
    # a point is left out for a query only if all its ids are the query's own
    own_id = np.where(lone, first, _NO_ID)
    by_id = np.argsort(own_id, kind="stable")
    at = by_id[np.minimum(np.searchsorted(own_id[by_id], query_ids), len(own_id) - 1)]
    skip = np.where(lone[at] & (own_id[at] == query_ids), at, -1)
    # points that share an id give fewer ids, and as many of them may be the query's own
    shared = int(np.unique(ids, return_counts=True)[1].max())
    _, found = tree.search(queries, min(k if shared == 1 else (k + 1) * shared, len(x)), skip, query_ids)
    row, col = np.nonzero(found >= 0)
    point = found[row, col]
    # each point stands for all ids kept for it
    n = heads[point + 1] - heads[point]
    row, pick = np.repeat(row, n), np.repeat(heads[point], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    point = np.repeat(point, n)
    out = pd.DataFrame({"query_id": query_ids[row], "vec_id": ids[by_place[pick]], "score": (queries[row] * x[point]).sum(1)})
    out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    return out.drop_duplicates(["query_id", "vec_id"]).groupby("query_id", sort=False).head(k)


def nearest(vectors: DataFrame, queries: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id",
            top: int = TOP, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``top`` nearest vectors of each query."""
    rows, asked = usable(vectors, vector_col, id_col), usable(queries, vector_col, id_col)
    sizes = K.written(rows.groupBy("dim").agg(F.ceil(F.count("*") / SHARD).alias("shards"), F.max("norm2").alias("high")), "vector-sizes")
    index = K.written(build_index(rows.join(sizes, "dim"), top), "vector-index")
    blocks = asked.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"dim": int(group["dim"].iloc[0]), "block": int(group["block"].iloc[0]),
                              "vectors": K.pack(np.stack(group["v"].to_numpy())), "ids": K.pack(group["vec_id"].to_numpy(np.int64))}])

    packed = (asked.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).select("dim", "block", "vec_id", "v")
              .groupBy("dim", "block").applyInPandas(pack, "dim int, block long, vectors binary, ids binary"))
    # every block goes to every shard, a pair of both to a task
    numbers = sizes.select(F.col("dim").alias("of_dim"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    pairs = K.written(packed, "query-blocks")
    left = pairs.join(numbers, F.col("dim") == F.col("of_dim")).select("dim", "block", F.col("shard").alias("of_shard"), "vectors", "ids")
    right = index.join(pairs.select(F.col("dim").alias("to_dim"), F.col("block").alias("to_block")), F.col("dim") == F.col("to_dim"))

    def run(key, block: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if block.empty or shard.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_shard(block.iloc[0], shard.iloc[0], top, factor)

    found = left.groupBy("dim", "block", "of_shard").cogroup(
        right.groupBy("to_dim", "to_block", "shard")).applyInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
