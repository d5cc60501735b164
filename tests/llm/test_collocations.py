import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kindred.llm import collocations as C

from .oracle import assert_equal

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest, top, percent=100):
    """By the definition: all phrases counted, each cut and each longer phrase looked at."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    c = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in c.items():
        if any(x == lang and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (x, q), b in c.items() if len(q) > len(p)):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_sql(spark):
    assert_equal(spark, "op11_collocations", "/root/testdata/sf0.01")


WORDS = ["a", "B", "cé", "日本", "e-f", "x y", "(z)", "9"]
GAPS = [" ", "  ", "\t ", ". ", ",", "\n", "\r\n", "\x0b", "?!", " "]


def texts(seed, n, size):
    r = np.random.default_rng(seed)
    return ["".join(WORDS[int(r.integers(8) * r.random())] + GAPS[int(r.integers(10))] for _ in range(int(r.integers(size)))) for _ in range(n)]


@pytest.mark.parametrize("share", [0.0, 0.05, 1.0])
def test_any_sample_gives_the_same(spark, share):
    """Also one that proposes nothing, so that all is found from failures of the border."""
    rows = [(t, ["en", None, "und", "x\ny"][i % 4]) for i, t in enumerate(texts(3, 60, 80))]
    got = rows_of(C.collocations(spark.createDataFrame(rows, "text string, lang string"), least=4, top=25, share=share))
    assert got == plain(rows, 4, 5, 25) and len(got) > 30


def test_percent_and_length(spark):
    rows = [(t, "en") for t in texts(5, 40, 60)]
    df = spark.createDataFrame(rows, "text string, lang string")
    for percent, longest in ((60, 4), (100, 2)):
        assert rows_of(C.collocations(df, least=3, longest=longest, percent=percent)) == plain(rows, 3, longest, 2000, percent)


def test_edge_rows(spark):
    rows = [(None, "en"), ("", "en"), (" .\t!", None), ("a b " * 60_000, None), ("q r.q r", ""), ("q r.q r", ""), ("A A A A A", "en")]
    df = spark.createDataFrame([(t, x, 1, "k") for t, x in rows], "text string, lang string, key int, n string")
    assert rows_of(C.collocations(df, least=2)) == plain(rows, 2, 5, 2000)
    assert C.collocations(df.where("false")).count() == 0
    assert C.collocations(df, least=10**9).count() == 0


def test_slices_and_groups(monkeypatch):
    """Words are the same however the bytes are cut."""
    t = pa.array(texts(9, 30, 200) + [None, "", "a" * 5000])
    whole = C.Words(t, ["en"] * len(t))
    monkeypatch.setattr(C, "SLICE_BYTES", 64)
    cut = C.Words(t, ["en"] * len(t))
    assert (whole.h == cut.h).all() and (whole.g == cut.g).all() and (whole.bytes == cut.bytes).all() and (whole.doc == cut.doc).all() and (whole.piece == cut.piece).all()


def test_equal_hashes_are_told_apart():
    number, first, count = C._numbered(np.array([5, 5, 5, 7], np.uint64), np.array([1, 2, 1, 1], np.uint64))
    assert number[0] == number[2] != number[1] and sorted(count) == [1, 1, 2] and len(first) == 3
