import hashlib
import re

from kindred.llm import secrets as S
from kindred.llm.queries import op6_secrets


def base(text):
    t, out = text or "", []
    for k, p, least in ((0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?-i:([A-Za-z0-9+/_.=-]+))""", 12), (1, "AKIA[A-Z0-9]+", 18), (2, "[0-9a-f]+", 16)):
        for m in re.finditer(p, t, re.I | re.A if k == 0 else 0):
            if len(m[2] if k == 0 else m[0]) >= least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def written(spans):
    return ",".join(f"{('assign', 'access', 'hex', 'opaque')[k]}:{a}:{b}" for a, k, b in spans)


def check(rows, got):
    assert len(rows) == len(got)
    by = {}
    for d, t, *_ in rows:
        by.setdefault(d, []).append(base(t))
    for r in got:
        b = next(b for b in by[r.doc_id] if hashlib.sha256(written(b).encode()).hexdigest() == r.base_sha256)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in b) for x in range(3)]
        every = r.spans.split(",") if r.spans else []
        assert [s for s in every if not s.startswith("opaque")] == (written(b).split(",") if b else [])


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert any(base(r.text) for r in rows)
    check(rows, op6_secrets(spark, sf).collect())


CASES = [
    (1, None, "a"), (2, "", "a"), (3, 'Password = "abcdefghijkl" x', "a"), (4, "token: token=abcdefghijklmnop", "b"), (5, "é日👩 api_key='ABC/def+123.=-_z' AKIA1234567890ABCD AKIA12", "b"),
    (6, "deadbeefdeadbeef0 password=deadbeefdeadbeef", "c"), (6, "deadbeefdeadbeef0 password=deadbeefdeadbeef", "c"), (6, "other", None), (None, "passwd==0123456789abcdef", None),
    (7, "0123456789abcdef" * 3000, "a"), (8, "aB3" * 10 + " owned", "a"), (9, "Zz9" * 9, "a"), (10, "Zz9" * 9, "b"), (11, "Zz9" * 9, "c"), (12, "key " + "9f" * 8 + " ", "a"), (13, "secret:\nabcdefghijklmnop ſecret=abcdefghijklmnop", "a"),
]


def test_edge_rows(spark):
    df = spark.createDataFrame([(*c, 0) for c in CASES], "doc_id long, text string, source string, kind int")
    got = S.secrets(df).collect()
    check(CASES, got)
    spans = {r.doc_id: r.spans for r in got}
    assert spans[8] == "opaque:0:30" and not spans[9] and not spans[11]
    assert S.secrets(df.where("false")).count() == 0


def test_redact(spark):
    df = spark.createDataFrame([(*c, 0) for c in CASES], "doc_id long, text string, source string, live_spans int")
    out = S.redact(df)
    assert out.columns == df.columns
    text = {(r.doc_id, r.source): r.text for r in out.collect()}
    assert out.count() == len(CASES) and text[1, "a"] is None and text[2, "a"] == ""
    assert text[3, "a"] == "[assign]\" x" and text[6, "c"] == "[hex] [assign]" and text[8, "a"] == "[opaque] owned" and text[9, "a"] == "Zz9" * 9


def test_redact_clashing_names_and_marks(spark):
    """Columns with the names that redact() uses inside, characters of four bytes, a byte order mark, and spans that meet."""
    rows = [(1, "\ufeff\ufeff👩 password=abcdefghijkl\ufeffé 0123456789abcdef", "a", "k", 5, "c", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row_key string, cuts int, chars string, last int, `from` int")
    out = S.redact(df)
    assert out.columns == df.columns
    assert [tuple(r) for r in out.collect()] == [(1, "\ufeff\ufeff👩 [assign]\ufeffé [hex]", *rows[0][2:])]


def test_brute_force_on_random_texts(spark):
    import random

    rng = random.Random(4)
    bits = ["token=", "AKIA", "0123456789abcdef", "Zz9_", "deadbeef", " ", ": ", "é", "password", "api-key", "'", "X1" * 9, "\n"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 80))), "a") for i in range(300)]
    got = S.secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    check(rows, got)
    text = {i: t for i, t, _ in rows}
    for r in got:  # opaque spans are runs that no base span touches
        own = [(m.start(), m.end()) for m in re.finditer("[A-Za-z0-9_+/-]{20,}", text[r.doc_id])]
        own = [f"opaque:{a}:{b}" for a, b in own if re.search("[0-9]", text[r.doc_id][a:b]) and re.search("[A-Za-z]", text[r.doc_id][a:b]) and not any(x < b and a < y for x, _, y in base(text[r.doc_id]))]
        assert set(s for s in r.spans.split(",") if s.startswith("opaque")) <= set(own)


def test_time_grows_with_the_matches(spark):
    """One text of many matches: four times the matches take no more than about four times the time."""
    import time

    took = []
    for n in (2_000, 10_000, 40_000):
        df = spark.createDataFrame([(1, " ".join(f"{i:016x}" for i in range(n)), "a")], "doc_id long, text string, source string")
        began = time.time()
        (row,) = S.secrets(df).collect()
        took.append(time.time() - began)
        assert row.n_hex == n
        (row,) = S.redact(df).collect()
        assert row.text == " ".join(["[hex]"] * n)
    assert took[2] < 6 * took[1] + 3
