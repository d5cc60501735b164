import math

import numpy as np
import pytest

from kindred.llm import whitening as W
from kindred.llm.queries import op13_whitening


def plain(vectors):
    """Exact sums in Python integers, the singular vectors of the whole centred matrix."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    d = [[n * c - t for c, t in zip(row, s, strict=True)] for row in x]
    a = np.array(d, float) / n
    _, s, v = np.linalg.svd(a, full_matrices=False)
    return n, [sum(c * c for c in row) for row in d], a, s * s / n, v.T


def check(rows, good, most=32):
    n, deviation, a, e, v = plain([vec for _, vec in good])
    k = min(most, int((e > 1e-20 * e[0]).sum()))
    by = {}
    for r in rows:
        by.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    assert len(rows) == k * n and {c for r in by.values() for c in r} == set(range(1, k + 1))
    got = np.array([[by[i, d][c].whitened for c in range(1, k + 1)] for (i, _), d in zip(good, deviation, strict=True)])
    want = a @ v[:, :k] / np.sqrt(e[:k])
    sign = np.sign((got * want).sum(0))
    assert np.abs(got - want * sign).max() < 1e-6
    first = rows[0]
    assert all(r.n == n and r.identity_error == first.identity_error for r in rows) and 0 <= first.identity_error < 1e-9
    assert np.abs(np.cov(got.T, bias=True).reshape(k, k) - np.eye(k)).max() < 1e-9
    for c in range(1, k + 1):
        assert abs({r.explained for r in rows if r.component == c}.pop() / (e[c - 1] / e.sum()) - 1) < 1e-8


def test_equals_plain(spark):
    sf = "/root/testdata/sf0.01"
    good = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    check(op13_whitening(spark, sf).collect(), good)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_badly_conditioned(spark):
    """Directions whose lengths differ by 10^6, the least of them the rounding to longs, far from 0: sums of raw squares
    would lose them."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((100, 8)) @ np.diag(10.0 ** np.arange(4, -4, -1))
    q, _ = np.linalg.qr(rng.standard_normal((8, 8)))
    good = [(i, [float(c) for c in v]) for i, v in enumerate(x @ q + 900)]
    check(W.whitened(frame(spark, good)).collect(), good)


def test_directions_without_length(spark):
    """A constant component and one that repeats another are no directions; nor are there more than rows less one."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((50, 3))
    good = [(i, [float(a), 2.0, float(b), float(a), float(c)]) for i, (a, b, c) in enumerate(x)]
    rows = W.whitened(frame(spark, good)).collect()
    assert {r.component for r in rows} == {1, 2, 3}
    n, deviation, a, e, v = plain([vec for _, vec in good])
    assert rows[0].identity_error < 1e-9 and {r.deviation for r in rows} == set(deviation)
    few = [(i, [float(c) for c in rng.standard_normal(10)]) for i in range(4)]
    assert {r.component for r in W.whitened(frame(spark, few)).collect()} == {1, 2, 3}


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(None, [1.0, 2.0]), (1, [3.0, -1.0]), (1, [3.0, -1.0]), (2, [0.5, 0.25])]
    df = frame(spark, [*good, (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [])]).selectExpr("*", "'a' AS x", "1 AS n", "2 AS whitened")
    rows = W.whitened(df).collect()
    assert sorted(str(r.vec_id) for r in rows) == ["1"] * 4 + ["2"] * 2 + ["None"] * 2 and rows[0].n == 4
    assert W.whitened(df.where("false")).count() == 0 and W.whitened(df.where("vec_id >= 3")).count() == 0
    assert W.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    with pytest.raises(ValueError):
        W.whitened(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
    with pytest.raises(OverflowError):
        W.whitened(frame(spark, [(1, [1e17]), (2, [1.0])]))


def test_solve():
    rng = np.random.default_rng(1)
    a, r = rng.standard_normal((9, 4)), [np.triu(rng.standard_normal((4, 4))) + 3 * np.eye(4) for _ in range(2)]
    assert np.abs(W.solve(a, r) @ r[1] @ r[0] - a).max() < 1e-12
