"""Encoders, role assignment, vectors: edge cases and properties."""

import itertools
import math
import random

from pyspark.sql import functions as F

from draftspark.functions.names import normalize_name
from draftspark.operators import encoders as E
from draftspark.operators import roles as R
from draftspark.operators import vectors as V

MATCH_SCHEMA = "gameid string, blue_picks array<string>, red_picks array<string>, blue_team string, red_team string, result int"


def mdf(spark, rows):
    return spark.createDataFrame(rows, MATCH_SCHEMA)


def test_title_case_matches_python(spark):
    names = [" kai'sa ", "AURELION SOL", "beşiktaş x2y", "nunu & willump", "Cho'Gath", "le blanc\t"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.t for r in df.select(normalize_name("n").alias("t")).collect()]
    assert got == [n.strip().title() for n in names]


def test_champion_win_rate_and_unseen_default(spark):
    m = mdf(spark, [("1", ["a", "b", "c", "d", "e"], ["f", "g", "h", "i", "j"], "X", "Y", 1),
                    ("2", ["a", "b", "c", "d", "e"], ["f", "g", "h", "i", "k"], "X", "Y", 0)])
    model = E.ChampionWinRateEstimator(smoothing=10.0).fit(m)
    g = model._scalars["g"]
    assert g == 0.5
    test = mdf(spark, [("3", ["A", "zz", "zz", "zz", "zz"], ["k"], "X", "Y", 1)])
    r = model.transform(test).first()
    a_rate = (1 + 10 * g) / (2 + 10)
    assert math.isclose(r.blue_champ_wr, (a_rate + 4 * g) / 5)   # unseen -> global mean, always / 5
    k_rate = (1 + 10 * g) / (1 + 10)
    assert math.isclose(r.red_champ_wr, k_rate / 5)


def test_team_strength_unseen_team_gets_prior(spark):
    m = mdf(spark, [(str(i), ["a"] * 5, ["b"] * 5, "X", "Y", i % 2) for i in range(10)])
    model = E.TeamStrengthEncoder(smoothing=15.0).fit(m)
    assert model._scalars["prior"] == 0.5   # inverted red labels: prior is exactly 0.5
    r = model.transform(mdf(spark, [("q", ["a"] * 5, ["b"] * 5, "Unknown", "X", 1)])).first()
    assert r.blue_team_strength == 0.5
    lam = 1 / (1 + math.exp(-(10 - 20) / 15))
    assert math.isclose(r.red_team_strength, 0.5 * (1 - lam) + 0.5 * lam)


def test_team_side_rate_priors(spark):
    m = mdf(spark, [("1", ["a"] * 5, ["b"] * 5, "X", "Y", 1), ("2", ["a"] * 5, ["b"] * 5, "X", "Y", 1),
                    ("3", ["a"] * 5, ["b"] * 5, "Y", "X", 0)])
    model = E.TeamSideWinRateEstimator(smoothing=10.0).fit(m)
    g = 2 / 3
    r = model.transform(mdf(spark, [("4", [], [], "Z", "Z", 0)])).first()
    assert math.isclose(r.blue_side_wr, g) and math.isclose(r.red_side_wr, 1 - g)


def _stats(spark, pairs):
    return spark.createDataFrame(pairs, "champion string, role string, games bigint")


def _brute(picks, table):
    roles = ["top", "jng", "mid", "bot", "sup"]
    best, best_s = picks, -1
    for p in itertools.permutations(picks):
        s = sum(table.get((c.strip().title(), r), 0) for c, r in zip(p, roles))
        if s > best_s:
            best, best_s = list(p), s
    return best


def test_role_assignment_matches_brute_force(spark):
    rnd = random.Random(7)
    champs = [f"C{i}" for i in range(12)]
    roles = ["top", "jng", "mid", "bot", "sup"]
    table = {(c, r): rnd.choice([0, 0, 1, 3, 7]) for c in champs for r in roles}
    stats = _stats(spark, [(c, r, g) for (c, r), g in table.items() if g])
    teams = [rnd.sample(champs, 5) for _ in range(60)] + [["c0", "c1", "c2"], champs[:6], ["Q1", "Q2", "Q3", "Q4", "Q5"]]
    m = mdf(spark, [(str(i), t, t, "X", "Y", 1) for i, t in enumerate(teams)])
    out = {r.gameid: r.blue_picks_sorted for r in R.assign_roles(m, stats).collect()}
    for i, t in enumerate(teams):
        expect = _brute(t, table) if len(t) == 5 else t
        assert out[str(i)] == expect, (t, out[str(i)], expect)
        assert sorted(out[str(i)]) == sorted(t)   # always a permutation


def test_signed_onehot_mirror_cancels_and_duplicates_count_once(spark):
    m = mdf(spark, [("1", ["a", "b", "c", "d", "e"], ["a", "f", "g", "h", "i"], "X", "Y", 1),
                    ("2", ["a", "a", "b", "c", "d"], ["e", "f", "g", "h", "i"], "X", "Y", 1)])
    vocab = V.vocabulary(m, role_aware=False)
    idx = {r.token: r["index"] for r in vocab.collect()}
    long = V.signed_onehot_long(m, vocab, role_aware=False)
    got = {(r.gameid, r["index"]): r.value for r in long.collect()}
    assert ("1", idx["A"]) not in got                 # mirrored pick cancels
    assert got[("2", idx["A"])] == 1.0                # duplicate pick counts once
    assert sorted(idx.values()) == list(range(len(idx)))


def test_swap_negates_hashed_and_onehot(spark):
    rows = [("1", ["a", "b", "c", "d", "e"], ["f", "g", "h", "i", "j"], "X", "Y", 1)]
    m = mdf(spark, rows)
    sw = m.select("gameid", F.col("red_picks").alias("blue_picks"), F.col("blue_picks").alias("red_picks"),
                  "blue_team", "red_team", "result")
    for mode in ("diff",):
        a = {(r["index"], r.value) for r in V.hashed_long(m, 300, mode).collect()}
        b = {(r["index"], -r.value) for r in V.hashed_long(sw, 300, mode).collect()}
        assert a == b
    vocab = V.vocabulary(m, role_aware=False)
    a = {(r["index"], r.value) for r in V.signed_onehot_long(m, vocab, role_aware=False).collect()}
    b = {(r["index"], -r.value) for r in V.signed_onehot_long(sw, vocab, role_aware=False).collect()}
    assert a == b


def test_embedding_vector_matches_long_form(spark):
    m = mdf(spark, [("1", ["a", "b", "c", "d", "e"], ["f", "g", "h", "i", "j"], "X", "Y", 1)])
    model = V.ChampionEmbedding(roleAware=False, outputCol="v").fit(m)
    vec = model.transform(m).first().v.toArray()
    assert len(vec) == 10 and sorted(vec.tolist()) == [-1.0] * 5 + [1.0] * 5


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _many_matches(spark):
    rnd = random.Random(11)
    champs = [f"Name {i}" for i in range(14)]
    return mdf(spark, [(str(i), rnd.choices(champs, k=rnd.choice([0, 3, 5, 5, 5, 6])), rnd.choices(champs, k=5), "X", "Y", i % 2) for i in range(60)])


def test_large_state_is_joined_with_the_same_results(spark, monkeypatch):
    """Beyond the size that travels in a plan, statistics and vocabulary are joined."""
    from draftspark.operators import lookup

    m = _many_matches(spark).checkpoint()
    stats = R.role_stats_long(m).checkpoint()
    small = R.assign_roles(m, stats)
    vocab = V.vocabulary(small, role_aware=True)
    want = small.select("gameid", "blue_picks_sorted", "red_picks_sorted")
    entries = V.signed_onehot_long(small, vocab, blue="blue_picks_sorted", red="red_picks_sorted")
    assert "Exchange" not in _plan(want) and "Exchange" not in _plan(entries) and "Python" not in _plan(entries)
    want, entries = sorted(map(tuple, want.collect()), key=str), sorted(map(tuple, entries.collect()), key=str)
    for module in (R, V):
        monkeypatch.setattr(module, "literal_map", lambda t, k, v: lookup.literal_map(t, k, v, 3))
    joined = R.assign_roles(m, stats)
    assert "Exchange" in _plan(joined)
    assert sorted(map(tuple, joined.select("gameid", "blue_picks_sorted", "red_picks_sorted").collect()), key=str) == want
    assert sorted(map(tuple, V.signed_onehot_long(joined, vocab, blue="blue_picks_sorted", red="red_picks_sorted").collect()), key=str) == entries


def test_sparse_vectors_equal_the_long_form(spark):
    from pyspark.ml.linalg import SparseVector

    m = _many_matches(spark)
    model = V.ChampionEmbedding(roleAware=False, outputCol="v").fit(m)
    for df, long in ((model.transform(m), V.signed_onehot_long(m, model._state["vocab"], False)),
                     (V.PickHasher(mode="concat", numFeatures=7, outputCol="v").transform(m), V.hashed_long(m, 7, "concat")),
                     (V.PickHasher(mode="diff", numFeatures=30, outputCol="v").transform(m), V.hashed_long(m, 30, "diff"))):
        assert "Exchange" not in _plan(df.select("v")) and "Python" not in _plan(df.select("v"))
        got = {}
        for r in df.collect():
            assert isinstance(r.v, SparseVector)
            got |= {(r.gameid, int(i)): float(x) for i, x in zip(r.v.indices, r.v.values, strict=True)}
        assert got == {(r.gameid, r["index"]): r.value for r in long.collect()}
