import re
import zlib

import numpy as np
import pytest

from kindred.llm import language_id as L
from kindred.llm.queries import op12_language_id


def plain_features(text):
    """Words and 2- to 4-grams of words with their bounds, as strings."""
    out = []
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        out.append(w)
        x = f"\0{w}\0"
        out += [x[i : i + n] for n in L.GRAMS for i in range(len(x) - n + 1)]
    return out


def test_features_are_those_of_the_words():
    for text in ("Ab cd", "a", "été, ab-ab 12 x", "  ..ab", "ab\n"):
        got = np.concatenate(list(L.features(text)))
        want = plain_features(text)
        assert len(got) == len(want)
        # a bucket a string: as many distinct ones, but for chance
        assert len(set(got.tolist())) >= len(set(want)) - 1
    assert [list(L.features(t)) for t in (None, "", "12 .,_")] == [[], [], []]


def test_slices(monkeypatch):
    text = "Ein Haus, zwei Häuser und ein sehrlangeswort " * 50
    whole = sorted(np.concatenate(list(L.features(text))).tolist())
    monkeypatch.setattr(L, "SLICE", 37)
    assert sorted(np.concatenate(list(L.features(text))).tolist()) == whole and len(list(L.features(text))) > 20


TEXTS = {"en": "the house and the dog were in the garden with her", "de": "das haus und der hund waren mit ihr im garten", "fr": "la maison et le chien dans le jardin avec elle"}


def rows(n, seed):
    rng = np.random.default_rng(seed)
    return [(lang, " ".join(rng.permutation(words.split())[:6])) for _ in range(n) for lang, words in TEXTS.items()]


def test_fit_by_the_definition():
    """The model's prediction is the softmax of the layer over the mean embedding of all features."""
    model = L.fit(rows(40, 1))
    again = L.Model.from_bytes(model.to_bytes())
    right = 0
    for lang, text in rows(20, 2):
        idx = np.concatenate(list(L.features(text)))
        z = (sum(model.embedding[i].astype(float) for i in idx) / len(idx) @ model.layer + model.bias) / model.temperature
        p = np.exp(z) / np.exp(z).sum()
        got = model.predict(text)
        assert got == again.predict(text) and got[0] == model.langs[p.argmax()] and abs(got[1] - p.max()) < 1e-9 and got[2] == (got[1] < model.threshold)
        right += got[0] == lang
    assert right >= 57


def test_gradients_by_differences():
    rng = np.random.default_rng(2)
    mean, layer, bias, k = rng.standard_normal(L.WIDTH), rng.standard_normal((L.WIDTH, 3)), rng.standard_normal(3), 1

    def loss(m, b):
        z = m @ layer + b
        return 2.5 * (np.log(np.exp(z).sum()) - z[k])

    p, back = L.gradients(mean, layer, bias, k, 2.5)
    for got, f, n in ((back, lambda d: loss(mean + d, bias) - loss(mean - d, bias), L.WIDTH), (p, lambda d: loss(mean, bias + d) - loss(mean, bias - d), 3)):
        assert np.abs(got - [f(1e-6 * np.eye(n)[j]) / 2e-6 for j in range(n)]).max() < 1e-6


def test_rejection_is_calibrated():
    """Of what is not rejected, as many are right as asked for; noise is rejected more than text."""
    rng = np.random.default_rng(4)
    noisy = [(list(TEXTS)[int(rng.integers(3))] if i % 4 == 0 else lang, t) for i, (lang, t) in enumerate(rows(100, 5))]
    model = L.fit(noisy, precision=0.8)
    got = [(lang, model.predict(t)) for lang, t in noisy[4::5]]
    kept = [(lang, p) for lang, p in got if not p[2]]
    assert not kept or sum(lang == p[0] for lang, p in kept) >= 0.7 * len(kept)
    sure = L.fit(rows(100, 6))
    assert sum(sure.predict(t)[2] for _, t in rows(20, 7)) <= 6
    assert all(sure.predict(t)[2] for t in ("12", "", None))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op12_language_id(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        letter = any(c.isalpha() for c in docs[r.doc_id].text or "")
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and (r.lang_pred == "und") == (not letter)
    held = [(r.lang_pred, docs[r.doc_id].lang) for r in got if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert len(held) > 100 and sum(p == t for p, t in held) >= 0.97 * len(held)


def test_edge_rows(spark):
    docs = spark.createDataFrame(
        [(i, t, lang, 0.5, "x") for i, (lang, t) in enumerate(rows(20, 8))] + [(1, None, "en", 0.5, "x"), (2, "", None, 0.5, "x"), (3, "12", "zz", 0.5, "x"), (None, "the dog", None, 0.5, "x"), (5, "the dog " * 100_000, None, 0.5, "x")],
        "doc_id long, text string, lang string, score double, lang_pred string")
    model = L.train(docs)
    got = L.score(docs, model)
    assert got.columns == [*docs.columns, "lang_pred_", "score_", "rejected"] and got.count() == 65
    assert got.where("lang_pred_ = 'und'").count() == 3 and got.where("length(text) > 1000").first().lang_pred_ == "en"
    assert L.identified(docs).count() == 65
    empty = L.train(docs.where("false"))
    assert empty.langs == [] and L.score(docs, empty).where("lang_pred_ <> 'und' or score_ <> 0").count() == 0
    assert L.identified(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        L.train(docs, sample=5000)
