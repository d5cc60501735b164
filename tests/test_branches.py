"""The closure of a branch against plain loops."""

from kindred.functions.text import COMMON_SURNAMES
from kindred.operators import branches as B
from kindred.operators.families import provisional_people

from .test_register import ACT, act, norm, plain, same

CARD = "seq long, name string, surname1 string, province string, place string, father string, mother string"


def walk(people, queue, provinces, prefixes, by_surname, hops=4, rounds=3):
    inside = lambda p, m: norm(p) in [x.lower() for x in provinces] or any(norm(m).startswith(norm(x)) for x in prefixes)
    cards = [dict(zip(("seq", "name", "s", "province", "place", "father", "mother"), r, strict=True)) for r in people]
    for c in cards:
        c.update(k=norm(c["name"]), inside=inside(c["province"], c["place"]))
        c["other"] = bool(c["province"] or c["place"]) and not c["inside"]
    cards = sorted((c for c in cards if c["k"]), key=lambda c: c["seq"])
    by = {}
    for c in cards:
        by.setdefault(c["k"], c)
    members = {c["k"]: ("place", 0) for c in cards if c["inside"]}
    for name, p, m in queue:
        if norm(name) and inside(p, m):
            members.setdefault(norm(name), ("queue", 0))
    for turn in range(1, rounds + 1):
        added = False
        for _ in range(hops):
            up = {norm(by[k][r]) for k in members if k in by for r in ("father", "mother")}
            new = {k for k in up if k in by and k not in members and not by[k]["other"]}
            if not new:
                break
            members |= {k: ("ancestor", turn) for k in new}
            added = True
        if added:
            continue
        if not by_surname:
            break
        own = set()
        for k in members:
            mine = sorted((not c["inside"], c["other"], c["seq"], plain(c["s"])) for c in cards if c["k"] == k and len(norm(c["s"])) > 2 and norm(c["s"]) not in COMMON_SURNAMES)
            if mine:
                own.add(mine[0][3])
        new = {c["k"] for c in cards if not c["other"] and c["k"] not in members and any(same(plain(c["s"]), s) for s in own)}
        if not new:
            break
        members |= {k: ("surname", turn) for k in new}
    return sorted((k, *v) for k, v in members.items())


PEOPLE = [
    (1, "Ana Torre", "Torre", "", "Villa Alta", "Blas Torre", "Eva Mora"), (2, "Blas Torre", "Torre", "", "", "Celso Torre", ""), (3, "Celso Torre", "Torre", "Lejos", "", "", ""), (4, "Eva Mora", "Mora", "", "", "Fausto Mora", "Gema Gil"),
    (5, "Fausto Mora", "Mora", "", "", "", ""), (6, "Gema Gil", "Gil", "", "", "", ""), (7, "Hugo Sáez-Torre", "Sáez-Torre", "", "", "Iván Sáez", ""), (8, "Iván Sáez", "Sáez", "", "", "", ""), (9, "Juan Torre", "Torre", "Lejos", "Otra", "", ""),
    (10, "Kiko García", "García", "ALTA", "", "", ""), (11, "Luis García", "García", "", "", "", ""), (12, None, "Torre", "", "", "", ""), (13, "ana  torre", "Otro", "Lejos", "", "Mal Padre", ""), (14, "Mal Padre", "Padre", "", "", "", ""),
    *[(20 + i, f"N{i} Largo", "Largo", "Alta" if i == 0 else "", "", f"N{i + 1} Largo", "") for i in range(9)],
]
QUEUE = [("Zoe Cola", "alta", ""), ("Hugo Sáez-Torre", "lejos", ""), (None, "alta", ""), ("Ana Torre", "alta", "")]


def test_closure(spark):
    people, queue = spark.createDataFrame(PEOPLE, CARD), spark.createDataFrame(QUEUE, "name string, province string, place string")
    for by_surname in (True, False):
        got = sorted(tuple(r) for r in B.closure(people, queue, ["Alta"], ["villa"], by_surname).select("k", "how", "round").collect())
        assert got == walk(PEOPLE, QUEUE, ["Alta"], ["villa"], by_surname)
    assert {"ancestor", "queue"} <= {h for _, h, _ in got}
    assert B.closure(people.where("false"), queue.where("false"), ["Alta"], ["villa"]).count() == 0


def test_query_is_the_walk(spark, sf):
    from pyspark.sql import functions as F

    from kindred.plans.tree import i7_closure
    from kindred.sources.adapters import tables

    t = tables(spark, sf)
    p = t["people"].select("seq", F.concat_ws(" ", "given", "surname1"), "surname1", F.lit(""), F.when(F.col("seq") % 2 == 0, F.col("place")).otherwise(""), "father", "mother")
    queue = t["findings"].where("homonym").select("person", F.lit(""), "place").collect()
    want = walk([tuple(r) for r in p.collect()], [tuple(r) for r in queue], [], ["NATION_3"], True)
    assert sorted(tuple(r) for r in i7_closure(t).select("k", "how", "round").collect()) == want
    assert {"place", "ancestor"} <= {h for _, h, _ in want}


def test_provisional_people(spark):
    """A mother known without a year is the child baptised in 1863; two Julians of other years stay two people."""
    from pyspark.sql import functions as F

    eus, leo = ("Eusebio", "Gil"), ("Leocadia", "Dopico")
    acts = spark.createDataFrame([act(1, 1863, "Leocadia", "Dopico", ("Juan", "Dopico"), ("Rosa", "Guzmán"), s2="Guzmán"), act(2, 1890, "Julián", "Gil", eus, leo), act(3, 1893, "Julián", "Gil", eus, leo, s2="Dopico"), act(4, None, "Ana", "Gil", eus, leo), act(5, 1870, "", "Gil", eus, leo)], ACT)
    got = {(r.k, r.year): r for r in provisional_people(acts.withColumns({"father_surname2": F.lit(""), "mother_surname2": F.lit("")})).collect()}
    assert set(got) == {("juan dopico", None), ("rosa guzman", None), ("leocadia dopico", 1863), ("eusebio gil", None), ("julian gil", 1890), ("julian gil", 1893), ("ana gil", None)}
    mother, ana = got["leocadia dopico", 1863], got["ana gil", None]
    assert mother.label == "Leocadia Dopico Guzmán" and mother.children == 3 and mother.father_id == got["juan dopico", None].id and ana.mother_id == mother.id
    assert [got[k].id for k in (("juan dopico", None), ("rosa guzman", None), ("leocadia dopico", 1863), ("eusebio gil", None), ("ana gil", None))] == ["AV001", "AV002", "AV003", "AV004", "AV005"]
    assert provisional_people(acts.where("false").withColumns({"father_surname2": F.lit(""), "mother_surname2": F.lit("")})).count() == 0
