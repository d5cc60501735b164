import zlib

import numpy as np
import public_tokenizers as P
import pytest

from kindred.llm import token_files as T
from kindred.llm.queries import op7_token_files

PATH = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 24, 31, 32])
def test_pack(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype("<u4")
    assert (T.unpack(T.pack(ids, bits), bits, len(ids)) == ids).all()
    assert len(T.pack(ids, bits)) == -(-len(ids) * bits // 8)


def test_file(tmp_path):
    docs = [np.arange(i * 7 % 50, dtype="<u4") for i in range(40)]
    raw = T.file_bytes([None, *range(1, 40)], [d.tobytes() for d in docs], 9, block=16)
    (tmp_path / "a.tok").write_bytes(raw)
    f = T.TokenFile(str(tmp_path / "a.tok"))
    assert f.is_null[0] and f.doc_ids[3] == 3
    for k, d in enumerate(docs):
        assert (f.document(k) == d).all()
    with pytest.raises(ValueError):
        T.file_bytes([1], [np.array([512], "<u4").tobytes()], 9)


def library(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def test_edge_rows(spark):
    texts = [None, "", "  ", "A b\x00c \x00 \x1cX\x1f", "Σας ΑΣ İ é 日本 " + "q" * 3000, "same", "same", "a <|endoftext|> b", "don't 12 x", "x<|STARTOFTEXT|>y <|endoftext|><|endoftext|>", "\u0558 a\u058bb \u088f"]
    df = spark.createDataFrame([(i if i != 6 else 5, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, start string")
    got = sorted(T.read(spark, T.write(df, PATH, end_id=1, by_word=True, file_tokens=5)).collect(), key=lambda r: (r.doc_id, r.start))
    at = 0
    for r, t in zip(got, texts, strict=True):
        want = library(t)
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.start == at and r.n_tokens == len(want)
        at += len(want)
    assert T.read(spark, T.write(df.where("false"), PATH, end_id=1)).count() == 0
    whole = T.read(spark, T.write(df, PATH, by_word=False)).collect()
    assert sum(r.n_tokens for r in whole) == at - len(texts)


def test_query(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    at = 0
    got = sorted(op7_token_files(spark, sf).collect())
    assert len(got) == len(rows)
    for r in got:
        want = library(rows[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)


def test_every_code_point():
    """As the library has it with nothing set, each code point between letters and by itself."""
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(PATH), T.WordCoder(PATH, True)
    for lo in range(0, 0x20000, 0x2000):
        texts = [x for p in range(lo, lo + 0x2000) if not 0xD800 <= p < 0xE000 for x in (f"a{chr(p)}b", chr(p))]
        for x, got, e in zip(texts, c.encode(texts), t.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == e.ids, x
