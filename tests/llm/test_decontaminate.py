import hashlib

from kindred.llm import decontaminate as D

from .oracle import assert_equal


def test_sql(spark):
    assert_equal(spark, "op2_decontaminate", "/root/testdata/sf0.01")


def brute(docs, items, window):
    import re

    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, x in items:
            v = words(x)
            n = min(window, len(v))
            for s in range(len(v) - n + 1 if v else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        ids.add("" if i is None else str(i))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_brute_force(spark):
    import random

    rng = random.Random(5)
    vocab = ["a", "B", "c", "dé", "日本", "x9", "k"]
    docs = [(i, " ".join(rng.choice(vocab) + rng.choice(["", ",", ". "]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "..."), (None, "a b c"), (5, "other a b c text"), (3, docs[3][1]), (103, "a " * 3000), (104, "...a b c..."), (105, "a b")]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 9)))) for i in range(12)] + [(50, None), (51, ""), (52, "a, b C"), (53, "zzz a b"), (None, "b"), (10, "k k"), (10, "c c"), (54, "a a a a a a a")]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, item_id string, pos int")
    it = spark.createDataFrame([(a, b, 2) for a, b in items], "item_id long, text string, doc_id int")
    got = D.contamination(df, it, window=4).drop("row_key").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, items, 4)
    assert D.contamination(df.where("false"), it).count() == 0
    none = D.contamination(df, it.where("false")).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)


def test_texts_cut_at_their_start(spark):
    """The rarest terms are amid the item, so that its windows are one group, or at its ends, so that they are several."""
    item = [f"v{i}" for i in range(15)]
    for rare in ((7, 8), (1, 13)):
        texts = [" ".join(item[i:]) for i in range(15)] + [" ".join(item[i:] + ["x"] + item[:i]) for i in range(15)] + [" ".join(item[: i + 1]) for i in range(15)]
        docs = list(enumerate(texts)) + [(100 + i, f"{w} x " * 40) for i, w in enumerate(item) if i not in rare]
        got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).drop("row_key").collect()
        assert sorted(map(tuple, got), key=repr) == brute(docs, [(7, " ".join(item))], 10)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one x two x three"), (2, "three two one"), (3, "one x x x x x x x x two three"), (4, None)], "doc_id long, text string")
    items = D.item_words(spark.createDataFrame([(7, "one two three")], "item_id long, text string"), 10)
    index = D.build_index(docs, items.selectExpr("explode(words) word").distinct())
    got = D.proximity_matches(index, items, 4).join(index.select("rid", "doc_id").distinct(), "rid").select("doc_id", "item_id").distinct().collect()
    assert sorted(map(tuple, got)) == [(1, "7"), (2, "7")]
