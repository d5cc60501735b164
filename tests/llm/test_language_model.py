import math
import zlib
from collections import Counter

import numpy as np
import pytest

from kindred.llm import elias_fano as EF
from kindred.llm import language_model as L
from kindred.llm.queries import op9_language_model

from .test_near_docs import words


@pytest.mark.parametrize("top,n", [(10, 3), (1000, 1000), (5000, 700), (1 << 40, 5000), ((1 << 64) - 1, 3000), (1, 1), (1 << 63, 1)])
def test_sequence(top, n):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=True)) if top > n else np.arange(n, dtype=np.uint64)
    s = EF.Sequence.of(v)
    head, arrays = EF.from_buffer(np.frombuffer(EF.to_bytes({"n": s.n, "l": s.l}, s.arrays()), np.uint8))
    s = EF.of_buffer(head, arrays)
    assert (s.values() == v).all()
    x = np.concatenate([v, rng.integers(0, top, 2000, dtype=np.uint64, endpoint=True), v + np.uint64(1), v - np.uint64(1)])
    at = {int(k): i for i, k in enumerate(v)}
    assert s.find(x).tolist() == [at.get(int(k), -1) for k in x]
    assert EF.Sequence.of(v[:0]).find(x).max() == -1


def model(train, min_count=2, d=0.75):
    """The same model in dictionaries."""
    c1, c2, c3 = Counter(), Counter(), Counter()
    for t in train:
        c1.update(t)
        c2.update(zip(t, t[1:]))
        c3.update(zip(t, t[1:], t[2:]))
    c2 = {k: n for k, n in c2.items() if n >= min_count}
    c3 = {k: n for k, n in c3.items() if n >= min_count}
    tokens, v = sum(c1.values()), len(c1)
    p1 = lambda w: (c1[w] + 0.5) / (tokens + 0.5 * (v + 1))
    used2, used3 = Counter(), Counter()
    for k, n in c2.items():
        used2[k[0]] += n - d
    for k, n in c3.items():
        used3[k[:2]] += n - d
    g2 = lambda h: 1 - used2[h] / c1[h] if h in used2 else 1
    g3 = lambda h: 1 - used3[h] / c2[h] if h in used3 else 1
    p2 = lambda h, w: (c2[h, w] - d) / c1[h] + g2(h) * p1(w) if (h, w) in c2 else g2(h) * p1(w)

    def p3(a, b, w):
        return (c3[a, b, w] - d) / c2[a, b] + g3((a, b)) * p2(b, w) if (a, b, w) in c3 else g3((a, b)) * p2(b, w)

    def score(t):
        return sum(math.log10(p1(w) if i == 0 else p2(t[0], w) if i == 1 else p3(t[i - 2], t[i - 1], w)) for i, w in enumerate(t))

    return c1, tokens, v, p1, score


def check(rows, got):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    tok = [(i, [*words(t), None]) for i, t in rows]
    c1, tokens, v, p1, score = model([t for i, t in tok if not held[i]])
    want = sorted((str(i), len(t), sum(c1[w] > 0 for w in t), sum(math.log10(p1(w)) for w in t), score(t)) for i, t in tok)
    assert len(want) == len(got)
    for w, r in zip(want, sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens, r.n_known, r.base_score)), strict=True):
        assert (w[0], w[1], w[2]) == (str(r.doc_id), r.n_tokens, r.n_known) and r.train_tokens == tokens and r.held_out == held[r.doc_id]
        assert r.base_score == pytest.approx(w[3], rel=1e-9, abs=1e-9) and r.score == pytest.approx(w[4], abs=2e-3 * w[1])


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op9_language_model(spark, sf).collect()
    check(rows, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "a B a b A b c"), (4, "a b c a b d"), (4, "a b c a b d e"), (None, "a b c"), (5, "x " * 5000), (6, "new words only"), (7, "a b"), (10, "b")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    check(rows, L.scored(df).collect())
    assert L.scored(df.where("false")).count() == 0
    alone = L.score(df, L.train(df.where("false"))).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in alone)


def test_sums_to_one(spark):
    df = spark.createDataFrame([(1, "a b a b a c b a b"), (2, "a b a c")], "doc_id long, text string")
    # after a context the words, the end and an unknown word's share make 1
    texts = [f"{h}{w}" for h in ("a b ", "b a ", "a ", "c ") for w in ("a", "b", "c", "zzz", "")]
    got = L.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), L.train(df)).collect()
    by = {r.doc_id: r.score for r in got}
    _, _, _, _, score = model([[*words(t), None] for t in ("a b a b a c b a b", "a b a c")])
    for k, t in enumerate(texts):
        assert by[k] == pytest.approx(score([*words(t), None]), abs=5e-3)
    for h in (["a", "b"], ["b", "a"], ["a"], ["c"]):
        before = score(h)
        assert sum(10 ** (score([*h, w]) - before) for w in ("a", "b", "c", None, "zzz")) == pytest.approx(1)
