import math
import zlib

import numpy as np

from kindred.llm import toxicity as X
from kindred.llm.queries import op8_toxicity


def test_features():
    stamp = np.zeros(1 << X.BITS, np.int32)
    a, b, c, d = X.features(["Ab cd", "aB CD", "", None], stamp)
    assert sorted(a) == sorted(b) and len(set(a)) == len(a) == 10 and len(c) == len(d) == 0


def plain_buckets(text):
    """One n-gram at a time, in Python integers."""
    m, t, out = 0xFFFFFFFF, text.lower(), set()
    for i in range(len(t)):
        h = 0
        for n in range(1, 6):
            if i + n > len(t):
                break
            h = (h * 0x01000193 & m) ^ (ord(t[i + n - 1]) * 0x9E3779B1 & m)
            if n >= 2:
                out.add(((h ^ (h >> 15)) * (0x2C1B3C6D + 2 * n) & m) >> (32 - X.BITS))
    return out


def plain_fit(rows, rate=1.0, ridge=1e-5, steps=80):
    """Ratios, unit vectors and the weighted logistic regression by the definition, in dictionaries and doubles."""
    y = [k for k, _ in rows]
    pos = sum(y)
    count = [{}, {}]
    for k, b in rows:
        for x in b:
            count[k][x] = count[k].get(x, 0) + 1
    ratio = {}
    for x in count[0].keys() | count[1].keys():
        p, q = count[1].get(x, 0), count[0].get(x, 0)
        r = math.log((p + 1) / (pos + 2)) - math.log((q + 1) / (len(y) - pos + 2))
        if p + q >= X.LEAST_TEXTS and abs(r) >= X.LEAST_RATIO:
            ratio[x] = r
    vectors = []
    for _, b in rows:
        v = {x: ratio[x] for x in b if x in ratio}
        norm = math.sqrt(max(sum(r * r for r in v.values()), 1e-12))
        vectors.append({x: r / norm for x, r in v.items()})
    w, b, gw, gb = dict.fromkeys(ratio, 0.0), 0.0, dict.fromkeys(ratio, 1e-8), 1e-8
    for _ in range(steps):
        g, h = {x: ridge * w[x] for x in w}, 0.0
        for k, v in zip(y, vectors, strict=True):
            e = (1 / (1 + math.exp(-(b + sum(w[x] * r for x, r in v.items())))) - k) * 0.5 / (pos if k else len(y) - pos)
            h += e
            for x, r in v.items():
                g[x] += e * r
        for x in w:
            gw[x] += g[x] ** 2
            w[x] -= rate * g[x] / math.sqrt(gw[x])
        gb += h * h
        b -= rate * h / math.sqrt(gb)
    return ratio, w, b


def test_fit_and_score_by_the_definition():
    rng = np.random.default_rng(3)
    vile, fine = "idiot stupid hate awful trash".split(), "house garden river bread music".split()
    texts = [(k, " ".join(rng.choice([*(vile if k else fine), "the", "and", "of"], 7))) for k in rng.integers(0, 2, 60).tolist()]
    stamp = np.zeros(1 << X.BITS, np.int32)
    rows = [(k, next(X.features([t], stamp)).copy()) for k, t in texts]
    assert all(set(idx.tolist()) == plain_buckets(t) for (_, t), (_, idx) in zip(texts, rows, strict=True))
    ratio, w, b = plain_fit([(k, plain_buckets(t)) for k, t in texts])
    model = X.fit([(k, idx) for k, idx in rows])
    live = np.flatnonzero(model.square)
    assert set(live.tolist()) == set(ratio) and len(ratio) > 50
    assert max(abs(model.square[x] - ratio[x] ** 2) for x in ratio) < 1e-5
    assert max(abs(model.weight[x] - w[x] * ratio[x]) for x in ratio) < 2e-2 and abs(model.intercept - b) < 2e-2
    for t in ("you stupid idiot", "the garden of the river", "", "zzz"):
        v = [x for x in plain_buckets(t) if x in ratio]
        z = b + sum(w[x] * ratio[x] for x in v) / max(1e-6, math.sqrt(sum(ratio[x] ** 2 for x in v)))
        got = model.score(next(X.features([t], stamp)))
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-2
    assert model.score(next(X.features(["you stupid idiot"], stamp))) > 0.5 > model.score(next(X.features(["the garden"], stamp)))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op8_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot", 5.0), (1, "you idiot", 5.0), (2, None, 5.0), (3, "", 5.0), (None, "x", 5.0), (4, "fine day " * 3000, 5.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (2, None), (None, 1), (9, 7)], "doc_id long, toxic int")
    assert X.scored(docs, labels).count() == 6
    assert X.scored(docs, labels.where("false")).where("score <> 0.5").count() == 0
    assert X.scored(docs.where("false"), labels).count() == 0
