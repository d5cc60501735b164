import numpy as np
import pytest

from kindred.llm import near_vectors as V

from .oracle import assert_equal


def brute(rows, t=0.98):
    ok = [(i, np.array(e, float), l) for i, e, l in rows if i is not None and l is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    n, root = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}
    for k in range(len(ok)):
        for m in range(k):
            (i, a, l), (j, b, o) = ok[k], ok[m]
            if l == o and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= t:
                n[i] += 1
                n[j] += 1
                x, y = sorted((root[i], root[j]))
                root = {p: x if r == y else r for p, r in root.items()}
    return sorted((i, n[i], root[i], root[i] == i) for i, *_ in rows)


def test_sql(spark):
    assert_equal(spark, "op1_near_vectors", "/root/testdata/sf0.01")


@pytest.mark.parametrize("shard_rows", [8192, 40])
def test_brute_force(spark, shard_rows):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        base = rng.normal(size=12)
        for _ in range(1 if i % 4 else rng.integers(1, 5)):
            rows.append((len(rows) * 3, (base + rng.normal(size=12) * rng.choice([0.0, 0.05, 0.12])).tolist(), int(i % 3)))
    chain = rng.normal(size=12)
    for _ in range(60):  # a long chain and a mass of near copies
        chain = chain + rng.normal(size=12) * 0.08
        rows.append((len(rows) * 3, chain.tolist(), 1))
    rows += [(len(rows) * 3 + k * 3, (base * rng.uniform(0.5, 9) + rng.normal(size=12) * 0.02).tolist(), 1) for k in range(100)]
    rows += [(90001, None, 1), (90002, [0.0] * 12, 1), (90003, [float("nan")] * 12, 1), (90004, rows[5][1], None), (90005, [], 1), (90006, [None, 1.0], 1), (90007, [1.0, 2.0], 1), (90008, [2.0, 4.0], 1), (90009, [1e-300, 2e-300], 1), (90010, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    got = sorted(map(tuple, V.near_vectors(df, shard_rows=shard_rows).collect()))
    assert got == brute(rows)


def test_recall():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.1])
    shard = V.Shard(V.Shard.to_bytes(np.arange(len(x)), x, float(np.cos(np.arccos(0.98) / 2))))
    q = V.unit_rows(x[:3000] + rng.normal(size=(3000, 32)) * 0.1).astype(np.float32)
    a, b = V.audited(shard.graph, q, np.float32(0.9), None)
    true = q @ shard.graph.x.T >= np.float32(0.9)
    met = np.zeros(true.shape, bool)
    met[a, b] = True
    assert (met & true).sum() >= 0.99 * true.sum()


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert V.near_vectors(df.where("false")).count() == 0
    assert sorted(r.component_id or 0 for r in V.near_vectors(df).collect()) == [0, 1, 1]
