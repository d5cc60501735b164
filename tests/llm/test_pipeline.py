import base64
import hashlib
import re

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline as C
from kindred.llm import secrets, toxicity

from .test_decontaminate import brute as contaminated
from .test_near_docs import brute as near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from kindred.llm._common import stored

    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, f in C.STAGES:
        out.append(stored(f(spark, out[-1], SF), name))
    return out


def test_stages(spark, stages):
    docs, clean, apart, pure, safe, coded = ([r.asDict() for r in s.collect()] for s in stages)
    assert [s.columns for s in stages[:5]] == [stages[0].columns] * 5
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = {r.doc_id for r in toxicity.scored(stages[0], labels).where("predicted = 1").collect()}
    assert bad and {r["doc_id"] for r in clean} == {r["doc_id"] for r in docs} - bad
    assert {r["doc_id"] for r in apart} == {i for i, _, _, kept in near([(r["doc_id"], r["text"]) for r in clean], 5, 80) if kept}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {r[0] for r in contaminated([(r["doc_id"], r["text"]) for r in apart], items, 10) if r[5]}
    assert {r["doc_id"] for r in pure} == {r["doc_id"] for r in apart} - hit
    before = {r["doc_id"]: r["text"] for r in pure}
    assert {r["doc_id"] for r in safe} == set(before)
    for r in safe:
        assert r["n_chars"] == len(r["text"])
    # a text changes exactly if it has live spans, and what gave way begins where a span does
    found = {r.doc_id: r for r in secrets.secrets(stages[3]).collect()}
    marks = re.compile("|".join(re.escape(f"[{k}]") for k, *_ in secrets.KINDS))
    for r in safe:
        old, f = before[r["doc_id"]], found[r["doc_id"]]
        assert (r["text"] != old) == (f.n_live > 0)
        if r["text"] != old:
            m = re.fullmatch("(.+?)".join(map(re.escape, marks.split(r["text"]))), old, re.DOTALL)
            assert m and {m.start(i + 1) for i in range(len(m.groups()))} <= {int(x.split(":")[1]) for x in f.spans.split(",")}
    assert any(f.n_live for f in found.values())
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r["doc_id"]: r["text"] for r in safe}
    assert {r["doc_id"] for r in coded} == set(text)
    for r in coded:
        ids = enc.encode_ordinary(text[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_empty(spark, stages):
    df = stages[0].where("false")
    for _, f in C.STAGES:
        df = f(spark, df, SF)
    assert df.count() == 0


def test_run(spark, stages):
    assert sorted(map(tuple, C.run(spark, SF).collect())) == sorted(map(tuple, stages[-1].collect()))
