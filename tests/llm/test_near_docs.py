import random
import re

import numpy as np
import pyarrow as pa
import pytest

from kindred.llm import _words as W
from kindred.llm import near_docs as N

from .oracle import assert_equal


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}
    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((root[ids[x]], root[ids[y]]))
                root = {i: p if r == q else r for i, r in root.items()}
    return sorted((i, len(sets[i]), root[i], root[i] == i) for i in ids)


def test_words_and_shingles():
    texts = ["", None, " A bé\tC\n", "日本 x", "one", "a b", "q" * 300 + " r", "  ", "x y z w"]
    raw, at = W.text_bytes(pa.array(texts))
    h, s, e, doc = W.words(raw, at)
    got = [[bytes(raw[s[i] : e[i]]).decode().lower() for i in range(doc[d], doc[d + 1])] for d in range(len(texts))]
    assert got == [words(t) for t in texts]
    flat = [w for g in got for w in g]
    assert len(set(h.tolist())) == len(set(flat)) and all((flat[i] == flat[j]) == (h[i] == h[j]) for i in range(len(flat)) for j in range(i))
    for k in (1, 2, 3, 5):
        sh, so = W.shingles(h, doc, k)
        assert np.diff(so).tolist() == [0 if not g else max(1, len(g) - k + 1) for g in got]
        assert len(sh) == so[-1]


def test_sql(spark):
    assert_equal(spark, "op4_near_documents", "/root/testdata/sf0.01")


@pytest.mark.parametrize("small", [128, 6])
def test_brute_force(spark, small):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.choice([1, 1, 2, 5, 14])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((len(rows) * 2, " ".join(t)))
    rows += [(9001, None), (9003, ""), (9005, " \t"), (9007, "A"), (9009, "a"), (9011, "a b"), (9013, "long " * 2000 + "x"), (9015, "long " * 2100 + "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    got = sorted(map(tuple, N.near_documents(df, 3, 85, small=small).collect()))
    assert got == brute(rows, 3, 85)


def test_long_boilerplate(spark):
    """Documents that share most words (similarity about 0.82) fill large nodes; pairs of 0.96 among them are found."""
    rng = random.Random(6)
    frame = [f"f{i}" for i in range(200)]
    texts = []
    for d in range(80):
        t = [*frame, *(f"o{d}x{i}" for i in range(22))]
        texts += [t, [*t[:-4], *(f"p{d}x{i}" for i in range(4))]]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, N.near_documents(df, 1, 90, trees=4, small=6).collect())) == brute(rows, 1, 90)


def quick_brute(rows, k, percent):
    """As brute, all pairs by one product of matrices."""
    sets = [{tuple(w[a : a + k]) for a in range(len(w) - k + 1)} for w in (words(t) for _, t in rows)]
    code = {g: i for i, g in enumerate(set().union(*sets))}
    m = np.zeros((len(rows), len(code)), np.float32)
    for i, x in enumerate(sets):
        m[i, [code[g] for g in x]] = 1
    both, n = m @ m.T, m.sum(axis=1)
    link = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    root = np.arange(len(rows))
    while True:
        low = np.array([root[link[i]].min() for i in range(len(rows))])
        if (low == root).all():
            break
        root = low
    ids = [i for i, _ in rows]
    return sorted((ids[i], len(sets[i]), ids[root[i]], bool(root[i] == i)) for i in range(len(rows)))


@pytest.mark.parametrize(("copies", "shingle", "percent"), [(800, 3, 85), (2500, 3, 85), (800, 5, 80)])
def test_large_group_of_near_copies(spark, copies, shingle, percent):
    """Near copies of one text, most pairs a little under or over the threshold: no link is lost, and there are about
    as many pairs as documents."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(copies):
        t = list(base)
        for _ in range(rng.choice([3, 4, 4, 6])):
            t[rng.randrange(200)] = f"x{rng.randrange(5000)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, N.near_documents(df, shingle, percent).collect())) == quick_brute(rows, shingle, percent)


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "A B C D")], "doc_id long, text string")
    got = N.near_documents(df).collect()
    assert len(got) == 4 and {r.n_shingles for r in got} == {1}
    by = [(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None]
    assert sorted(by) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert N.near_documents(df.where("false")).count() == 0


def test_repeated_ids(spark):
    """Rows of one id are one document: a copy in one of its texts does not hide the others."""
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "p q r s t u"), (3, "p q r s t u"), (4, "x y z x y z")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in N.near_documents(df).collect()) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4)]
