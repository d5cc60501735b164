import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest

from kindred.llm import byte_bpe
from kindred.llm.queries import op10_byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", None, " ", "a", "  a  b\n\n c\t\td ", "aaaaaaa aaaaaaaaaaaaaa", "don't we'll I'M 12345 x1y2", "\x1c\x1d a\x00b \x85 \xa0x", "日本語 テキスト 👩‍👩‍👧 é é", "x" * 5000, "<|endoftext|> ok", "a 　 b c"]


def test_like_the_library(spark, plain):
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in byte_bpe.encode_decode(df, PATH, P.PATTERN, offsets="spans").collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = plain.encode_ordinary(t or "")
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want and got[i].n_ids == len(want)
        assert bytes(got[i].decoded) == (t or "").encode()
        assert len(got[i].spans) == len(want)
        if t:
            assert got[i].spans[0].start == 0 and got[i].spans[-1].end == len(t)
    back = byte_bpe.decode(byte_bpe.encode_decode(df, PATH, P.PATTERN, decoded=None), PATH, P.PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded) for r in back} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}


def test_long_texts_in_turns(plain, monkeypatch):
    monkeypatch.setattr(byte_bpe, "TURN", 40)
    c = byte_bpe.Coder(PATH, P.PATTERN)
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab  \n\t'1.é日"), n)) for n in (39, 41, 500, 3000)] + ["x" * 500, " " * 300 + "y", "a b " * 90]
    assert c.encode([*texts, None, *TEXTS]) == [np.array(plain.encode_ordinary(t or ""), "<u4").tobytes() for t in [*texts, None, *TEXTS]]


def test_query(spark, sf, plain):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op10_byte_bpe(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = plain.encode_ordinary(rows[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((rows[r.doc_id] or "").encode()).hexdigest()


def test_empty(spark):
    assert byte_bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0
