"""Ops 12 and 13 against plain versions: eigenvectors by LAPACK and exact sums, searches by comparing everything."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from roostwright.llm import eigen, search, whitening

VECTORS = "vec_id long, embedding array<double>"


def test_characteristic_polynomial_is_exact(spark):
    r = random.Random(1)
    rows = [[r.randint(-(10**9), 10**9) for _ in range(9)] for _ in range(9)]
    m = [[sum(a * b for a, b in zip(x, y, strict=True)) for y in rows] for x in rows]
    got = whitening.characteristic(spark, m)
    for x in range(10):  # by Fractions: det(xI - m)
        a = [[Fraction((x if i == j else 0) - m[i][j]) for j in range(9)] for i in range(9)]
        det = Fraction(1)
        for k in range(9):
            i = next(i for i in range(k, 9) if a[i][k])
            if i != k:
                a[i], a[k], det = a[k], a[i], -det
            det *= a[k][k]
            for i in range(k + 1, 9):
                f = a[i][k] / a[k][k]
                a[i] = [p - f * q for p, q in zip(a[i], a[k], strict=True)]
        assert det == sum(c * x**i for i, c in enumerate(got))


def test_roots_are_isolated_with_their_multiplicity():
    def product(*roots):
        p = [1]
        for c in roots:
            p = [(p[i - 1] if i else 0) - c * (p[i] if i < len(p) else 0) for i in range(len(p) + 1)]
        return p

    big = 10**30
    roots = eigen.ranked_roots(product(0, 0, 3, 3, 3, big, big + 1, 7, 7, 64), 99)
    assert [(round(r.mid()), r.times) for r in roots] == [(big + 1, 1), (big, 1), (64, 1), (7, 2), (3, 3)]
    assert [round(r.mid()) for r in eigen.ranked_roots(product(1, 2, 4, 8), 2)] == [8, 4]


def plain_whitening(vectors):
    x = np.floor(64 * np.array(vectors)) + 1000000
    e, u = np.linalg.eigh(np.cov(x.T, bias=True))
    e, u = e[::-1], u[:, ::-1]
    return e, (x - x.mean(axis=0)) @ u[:, e > 1e-9] / np.sqrt(e[e > 1e-9])


@pytest.mark.parametrize("kind", ["plain", "wide", "flat", "equal variances"])
def test_whitening_agrees_with_lapack(spark, kind):
    r = np.random.default_rng(3)
    v = r.normal(size=(300, 7)) * [1, 2, 3, 4, 5, 6, 7]
    if kind == "wide":
        v = v * 1e7
    if kind == "flat":  # two dimensions are sums of others
        v = np.floor(v * 64) / 64
        v[:, 5], v[:, 6] = v[:, 0] + v[:, 1], v[:, 2]
    if kind == "equal variances":
        v = np.vstack([np.eye(7), -np.eye(7)])
    df = spark.createDataFrame([(i, x.tolist(), "a") for i, x in enumerate(v)], f"{VECTORS}, `a.b` string").withColumn("whitened", F.lit("clash"))
    df = df.unionByName(df.limit(0)).repartition(3)
    model = whitening.fit(df)
    got = whitening.whiten(df, model).orderBy("vec_id").collect()
    assert model.n == len(v) and model.identity_error < 1e-9 and got[0]["a.b"] == "a"
    e, want = plain_whitening(v)
    w = np.array([x.whitened for x in got])
    assert w.shape == want.shape and np.allclose(model.explained(), (e / e.sum())[: w.shape[1]], rtol=1e-6)
    if kind != "equal variances":  # any basis will do there
        assert np.allclose(np.abs(w), np.abs(want), atol=1e-6)
    x = [[int(c) for c in row] for row in np.floor(64 * v)]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert [int(g.deviation) for g in got] == [sum((len(x) * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]


def test_whitening_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 1.0]), (None, [3.0, 2.0]), (1, [1.0, 2.0])]
    df = spark.createDataFrame(rows, VECTORS)
    model = whitening.fit(df)
    out = whitening.whiten(df, model).collect()
    assert sorted(str(r.vec_id) for r in out) == ["1", "1", "None"] and model.n == 3 and len(model.values) == 1 and model.identity_error < 1e-12
    for few in (df.limit(0), spark.createDataFrame([(1, [1.0, 2.0])] * 3, VECTORS), spark.createDataFrame([(1, [])], VECTORS)):
        model = whitening.fit(few)
        assert model.values == [] and model.identity_error is None and all(r.whitened == [] and r.deviation == 0 for r in whitening.whiten(few, model).collect())
    with pytest.raises(Exception, match="one length"):
        whitening.fit(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], VECTORS).repartition(1))


def plain_search(rows, k, scale=256):
    ok = [(i, v, [int(np.floor(scale * c)) for c in x]) for i, (v, x) in enumerate(rows) if x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for i, v, x in ok:
        if v is not None and v % 50 == 0:
            scores = [(-sum(a * b for a, b in zip(x, y, strict=True)), w is None, w or 0, w) for j, w, y in ok if j != i]
            out += [(v, r, w, -s) for r, (s, _, _, w) in enumerate(sorted(scores, key=lambda t: t[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["random", "clustered", "copies", "ties", "large"])
def test_search_finds_what_comparing_all_finds(spark, kind):
    r = np.random.default_rng(5)
    n, d = 600, 8
    x = r.normal(size=(n, d))
    if kind == "clustered":
        x = r.normal(size=(9, d))[r.integers(0, 9, n)] + 0.02 * x
    if kind == "copies":  # a third of the rows are one vector
        x[: n // 3] = x[0]
    if kind == "ties":
        x = r.integers(-1, 2, (n, d)) / 256
    if kind == "large":
        x = x * 1e5
    rows = [(int(i), v.tolist()) for i, v in zip(r.permutation(n), x, strict=True)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"row": F.lit("clash"), "cell": F.lit(1)}).repartition(5)
    got = search.top_k(df, F.col("vec_id") % 50 == 0, block_rows=40, tile_queries=3, most_pivots=6)
    assert sorted([(g.query_id, g["rank"], g.vec_id, g.score) for g in got.collect()], key=str) == plain_search(rows, 5)


def test_search_scores_few_candidates_of_clustered_vectors(spark, monkeypatch):
    """Exact stopping: most candidates are passed over by their bounds."""
    r = np.random.default_rng(6)
    x = np.floor(256 * (r.normal(size=(8, 16)) * 4)[r.integers(0, 8, 4000)] + r.normal(size=(4000, 16)) * 8)
    pivots = search.pick_pivots(x[:500], 24)
    scored = []
    monkeypatch.setattr(search, "products", lambda a, q, exact: scored.append(len(a)) or (a @ q).astype(np.int64))
    block = search.Block(np.arange(4000), np.arange(4000), x, search.distances(x, pivots), (x * x).sum(axis=1))
    ask = search.Block(*(v[:40] for v in (block.row, block.ids, block.x, block.table, block.lengths)))
    for i, at, scores in block.search(ask, np.full(40, -(1 << 62)), 5):
        want = sorted(((-int(s), j) for j, s in enumerate(x @ x[i]) if j != i))[:5]
        assert [(-s, j) for j, s in zip(at, scores, strict=True)] == want
    assert sum(scored) < 0.5 * 40 * 4000


def test_search_in_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(50, [1.0, 2.0]), (50, [1.0, 2.0]), (7, None), (8, [nan, 1.0]), (9, [None, 1.0]), (100, [inf, 1.0]), (None, [1.0, 2.0]), (3, [1.0, 2.0]), (0, [-1.0, 0.5])]
    ask = F.col("vec_id") % 50 == 0
    tuples = lambda df: sorted([(g.query_id, g["rank"], g.vec_id, g.score) for g in df.collect()], key=str)
    assert tuples(search.top_k(spark.createDataFrame(rows, VECTORS), ask)) == plain_search(rows, 5)
    assert tuples(search.top_k(spark.createDataFrame(rows[2:6], VECTORS), ask)) == [] == tuples(search.top_k(spark.createDataFrame(rows[:1], VECTORS), ask))
    assert tuples(search.top_k(spark.createDataFrame(rows[7:8], VECTORS), ask)) == []
    empty = [(0, []), (1, [])]
    assert tuples(search.top_k(spark.createDataFrame(empty, VECTORS), ask)) == [(0, 1, 1, 0)]
    with pytest.raises(Exception, match="one length"):
        search.top_k(spark.createDataFrame([(0, [1.0]), (2, [1.0, 2.0])], VECTORS).repartition(1), ask).collect()
