import numpy as np
import pytest

from draftspark.llm import vptree as M


def brute(rows, ask, top=20):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in good:
        if ask(q):
            near = sorted((-float((v * w).sum()), i) for i, w in good if i != q and len(w) == len(v))[:top]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(near, 1)]
    return sorted(out)


def same(got, want):
    got = sorted(map(tuple, got))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)


def test_exact_on_random_vectors(llm, monkeypatch):
    monkeypatch.setattr(M, "SHARD", 300)
    monkeypatch.setattr(M, "BLOCK", 20)
    monkeypatch.setattr(M, "LEAF", 16)
    x = np.random.default_rng(2).normal(size=(900, 8))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>")
    same(M.nearest(df, df.where("vec_id % 20 = 0")).collect(), brute(rows, lambda q: q % 20 == 0))


def test_ties_repeats_and_unusable_vectors(llm):
    rows = [(i, [1.0, 2.0]) for i in range(100)] + [(i, [2.0, 1.0]) for i in range(100, 130)] + [(140, None), (160, [0.0, 0.0]), (180, [float("nan"), 1.0]), (200, [None, 1.0]),
            (220, [float("inf"), 1.0]), (240, []), (260, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (280, [-1.0, -2.0]), (300, [1.0, 1.0, 1.0])]
    df = llm.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, shard string, dim string")
    same(M.nearest(df, df.where("vec_id % 20 = 0")).collect(), brute(rows, lambda q: q % 20 == 0))
    assert M.nearest(df.limit(0), df.limit(0)).count() == 0
    one = df.where("vec_id = 0")
    assert M.nearest(one, one).count() == 0


def brute_by_id(rows, ask, top=20):
    vectors, out = {}, []
    for i, v in rows:
        vectors.setdefault(i, []).append(np.array(v, float))
    for q in filter(ask, vectors):
        near = sorted((-max(float((v * w).sum()) for v in vectors[q] for w in own), i) for i, own in vectors.items() if i != q)[:top]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("values", [[0.0, 1.0], [0.1, 0.2, 0.7]])
def test_tied_different_vectors_and_repeated_rows(llm, monkeypatch, values):
    monkeypatch.setattr(M, "SHARD", 400)
    monkeypatch.setattr(M, "BLOCK", 20)
    monkeypatch.setattr(M, "LEAF", 16)
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in zip(rng.permutation(900).tolist(), rng.choice(values, (900, 9)).tolist(), strict=True) if any(v)]
    rows += [(1000 + i, np.eye(9)[i % 9].tolist()) for i in range(50)]
    df = llm.createDataFrame(rows + [r for r in rows if r[0] % 3 == 0] * 2, "vec_id long, embedding array<double>")
    same(M.nearest(df, df.where("vec_id % 20 = 0")).collect(), brute_by_id(rows, lambda q: q % 20 == 0))


def test_ids_with_several_vectors(llm, monkeypatch):
    monkeypatch.setattr(M, "LEAF", 16)
    rows = [(i % 70, v) for i, v in enumerate(np.random.default_rng(6).integers(-2, 3, (300, 4)).astype(float).tolist()) if any(v)]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>")
    same(M.nearest(df, df.where("vec_id % 5 = 0")).collect(), brute_by_id(rows, lambda q: q % 5 == 0))


@pytest.mark.parametrize("factor,least", [(1.0, 1.0), (1.5, 0.9)])
def test_factor_trades_recall_for_visits(factor, least, monkeypatch):
    monkeypatch.setattr(M, "LEAF", 32)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 4)).repeat(100, 0) + rng.normal(size=(4000, 4)) * 0.02
    x /= np.sqrt((x ** 2).sum(1))[:, None]
    high = float((x ** 2).sum(1).max())
    order, links, ranges = M.build_tree(np.concatenate([x, np.sqrt(np.maximum(high - (x ** 2).sum(1), 0))[:, None]], 1))
    tree = M.Tree(x[order], links, ranges, high, factor)
    score, _ = tree.search(x[:200], 10, np.full(200, -1))
    true = -np.sort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert (score >= true[:, -1:] - 1e-9).mean() >= least
    assert tree.visited < 200 * 4000
