"""Functions of a row that run in the JVM."""

from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from draftspark.functions.names import normalize_name
from draftspark.operators.roles import best_order
from draftspark.operators.vectors import _summed, hashed_entries, sparse_vector


def test_entries_are_summed_up_in_order(spark):
    """Also where an index or a value is missing, as of a pick without a name."""
    df = spark.createDataFrame([(0, [(5, 1.0), (2, -1.0), (5, 0.5), (7, 1.0), (7, -1.0)]), (1, [(None, None), (3, 1.0), (None, None)]), (2, [(4, None), (4, 1.0), (1, 2.0)]), (3, []), (4, None)],
                               "id int, e array<struct<index:bigint,value:double>>")
    got = {r["id"]: r["s"] if r["s"] is None else [tuple(x) for x in r["s"]] for r in df.select("id", _summed(F.col("e")).alias("s")).collect()}
    assert got == {0: [(2, -1.0), (5, 1.5)], 1: [(3, 1.0)], 2: [(1, 2.0)], 3: [], 4: None}
    vectors = {r["id"]: r["v"] for r in df.where("id < 4").select("id", sparse_vector(_summed(F.col("e")), 9).alias("v")).collect()}
    assert [v.size for v in vectors.values()] == [9] * 4 and vectors[0].toArray().tolist() == [0, 0, -1, 0, 0, 1.5, 0, 0, 0]


def test_a_missing_pick_has_no_index(spark):
    df = spark.createDataFrame([(["a", None, "b"], ["c"]), (["a", "b"], ["c", None])], "blue_picks array<string>, red_picks array<string>")
    a, b = ([x for x in r[0] if x["index"] is not None] for r in df.select(hashed_entries(300, "diff")).collect())
    assert a == b and len(a) == 3


def test_best_order_is_the_first_best_permutation(spark):
    rng = np.random.default_rng(5)
    teams = [rng.integers(0, 3, (5, 5)).tolist() for _ in range(40)] + [[None, [1, 2, 3, 4, 5], None, None, [9, 9, 9, 9, 9]], [[0] * 5] * 5]
    got = [r[0] for r in best_order(spark.createDataFrame([(i, t) for i, t in enumerate(teams)], "i int, s array<array<bigint>>"), "s", "o").orderBy("i").select("o").collect()]
    for team, order in zip(teams, got, strict=True):
        count = [x or [0] * 5 for x in team]
        assert tuple(order) == max(permutations(range(5)), key=lambda p: (sum(count[p[r]][r] for r in range(5)), [-x for x in p]))


def test_plain_names_are_titled_as_others(spark):
    names = ["hot BOLT", "  a  b ", "", " ", "kai'sa", "x2y", "abc\n", "nunu & willump", "\u00e9t\u00e9 now", None]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", normalize_name("n").alias("t")).orderBy("i").select("t").collect()]
    assert got == ["Hot Bolt", "A  B", "", "", "Kai'Sa", "X2Y", "Abc", "Nunu & Willump", "\u00c9t\u00e9 Now", None]
