"""The lineage with its register against plain loops over the same rules."""

import re
import unicodedata

import pytest

from kindred.operators import register as R
from kindred.sources.adapters import tables


def norm(x):
    return re.sub(r"\s+", " ", "".join(c for c in unicodedata.normalize("NFD", (x or "").lower()) if not unicodedata.combining(c))).strip()


def key(x):
    return re.sub(r"(.)\1+", r"\1", norm(x).translate(str.maketrans("vy", "bi", "h")))


def plain(x):
    return norm(x).replace("-", " ")


def same(a, b):
    return bool(a and b) and (a == b or len(a) >= 4 and len(b) >= 4 and (a in b or b in a))


def order(values):
    return tuple((v is not None, v) for v in values)


def resolve(come, nodes, born):
    """Gives each mention its node; returns the new nodes."""
    open_ = []
    for m in come:
        met = [n for n in nodes if n["branch"] == m["branch"] and n["g"] == m["g"] and same(n["s"], m["s"]) and (n["year"] is None or m["year"] is None or abs(n["year"] - m["year"]) <= 15)]
        if met:
            m["node"], m["new"] = min((n["born"], n["node"]) for n in met)[1], False
        else:
            open_.append(m)
    for m in open_:
        heads = [o["s"] for o in open_ if o["branch"] == m["branch"] and o["g"] == m["g"] and same(o["s"], m["s"])]
        m["head"] = min((len(s), s) for s in heads)[1]
    groups = {}
    for m in open_:
        groups.setdefault((m["branch"], m["g"], m["head"]), []).append(m)
    fresh = []
    for (branch, g, head), ms in groups.items():
        undated = any(m["year"] is None for m in ms)
        parts = {}
        for m in ms:
            parts.setdefault(None if undated else (m["year"] - min(x["year"] for x in ms)) // 16, []).append(m)
        for part, xs in parts.items():
            y = None if part is None else min(x["year"] for x in xs)
            node = f"{branch}|{g}|{head}|{'' if y is None else y}|{born}"
            for x in xs:
                x["node"], x["new"] = node, True
            top = min(xs, key=lambda x: order([x["role"] != "line", x["generation"], x["estimate"], x["act"], x["g"], x["given"], x["surname2"], x["lo"], x["hi"], x["parish"], x["place"], x["state"], x["confidence"], x["origin"]]))
            fresh.append({**{k: top[k] for k in R.NODE if k not in ("node", "s", "year", "born")}, "node": node, "s": head, "year": y, "born": born})
    return fresh


def walk(seeds, acts, most=14, floor=1550, children=30):
    acts = [a for a in acts if a["kind"] == "bautismo"]
    blank = {"surname2": "", "act": None, "confidence": "", "origin": "", "state": "pending", "role": "line"}
    come = [{**blank, "branch": s["branch"], "g": s["given"].strip().lower(), "given": s["given"], "s": plain(s["surname1"]), "year": s["year"], "estimate": s["year"], "lo": s["lo"], "hi": s["hi"], "parish": s["parish"], "place": s["place"], "generation": 0} for s in seeds]
    nodes, links, other, born = resolve([m for m in come if m["s"]], [], 0), set(), set(), 0
    for m in sorted((m for m in come if not m["s"]), key=lambda m: order([m["given"], m["s"]])):
        node = f"{m['branch']}|{m['g']}|||0"
        if all(n["node"] != node for n in nodes):
            nodes.append({**m, "node": node, "born": 0})
    while now := [n for n in nodes if n["state"] == "pending"]:
        born += 1
        come = []
        for n in now:
            if n["generation"] > most:
                n["state"] = "no_result"
            elif not n["g"] or not n["s"] or n["lo"] is None or n["hi"] is None:
                n["state"] = "no_data"
            elif n["hi"] < floor:
                n["state"] = "no_result"
            else:
                k, mid = key(n["given"]), (n["lo"] + n["hi"]) / 2
                points = lambda a: 3 * (n["parish"] != "" and norm(a["parish"]) == norm(n["parish"])) + 2 * (n["place"] != "" and norm(a["municipality"]) == norm(n["place"])) + 2 * (n["surname2"] != "" and same(plain(a["surname2"]), plain(n["surname2"])))  # noqa: E731, B023
                hits = sorted((-points(a), abs(a["year"] - mid), a["id"]) for a in acts if a["year"] is not None and n["lo"] <= a["year"] <= n["hi"] and key(a["given"]) == k and same(plain(a["surname1"]), n["s"]))
                other |= {(n["node"], i, h[2]) for i, h in enumerate(hits[1:6], 1)}
                own = next((a for a in acts if hits and a["id"] == hits[0][2]), None)
                ref = own["year"] if own else n["estimate"]
                kids = [] if ref is None else sorted((a for a in acts if a["year"] is not None and ref + 18 <= a["year"] <= ref + 50 and any(g and key(g) == k and same(plain(s), n["s"]) for g, s in ((a["father_given"], a["father_surname"]), (a["mother_given"], a["mother_surname"])))), key=lambda a: a["id"])[:children]
                for a in kids:
                    come.append({"branch": n["branch"], "g": a["given"].strip().lower(), "given": a["given"], "s": plain(a["surname1"]), "surname2": a["surname2"], "year": a["year"], "estimate": a["year"], "lo": None, "hi": None, "parish": a["parish"] or "", "place": a["municipality"] or "", "generation": n["generation"] - 1, "role": "collateral", "state": "identified", "act": a["id"], "confidence": "high", "origin": n["node"]})
                n["state"] = "identified" if own else "doubtful" if kids else "no_result"
                if own:
                    n.update({"given": own["given"] or n["given"], "surname2": own["surname2"] or n["surname2"], "year": own["year"], "parish": own["parish"] or n["parish"], "place": own["municipality"] or n["place"], "act": own["id"], "confidence": "high" if -hits[0][0] >= 3 else "mid" if -hits[0][0] >= 2 else "low"})
                    for role in ("father", "mother"):
                        if own[f"{role}_given"]:
                            come.append({**blank, "branch": n["branch"], "g": own[f"{role}_given"].strip().lower(), "given": own[f"{role}_given"], "s": plain(own[f"{role}_surname"]), "year": None, "estimate": own["year"] - 28, "lo": own["year"] - 35, "hi": own["year"] - 18, "parish": own["parish"] or "", "place": "", "generation": n["generation"] + 1, "origin": n["node"], "is": role})
        fresh = resolve([m for m in come if m["s"]], nodes, born)
        links |= {(m["origin"], m["node"], m["is"]) for m in come if "is" in m and "node" in m}
        for n in nodes:
            seen = [m["act"] for m in come if m.get("node") == n["node"] and not m["new"] and m["role"] == "collateral"]
            if seen and n["state"] in ("doubtful", "no_result", "no_data"):
                n.update(state="identified", act=min(seen), confidence="high")
        nodes += fresh
        for m in come:
            if not m["s"] and m["role"] == "line":
                node = f"{m['branch']}|{m['g']}||{m['origin']}"
                links.add((m["origin"], node, m["is"]))
                if all(n["node"] != node for n in nodes):
                    nodes.append({**m, "node": node, "born": born})
    return nodes, links, other


COLS = [c for c in R.NODE]


def compare(spark, seeds, acts, **kw):
    got = R.lineage(seeds, acts, **kw)
    nodes, links, other = walk([r.asDict() for r in seeds.collect()], [r.asDict() for r in acts.collect()], **{k: v for k, v in kw.items() if k != "rounds"})
    have = {r.node: tuple(r[c] for c in COLS) for r in got.nodes.collect()}
    want = {n["node"]: tuple(n[c] for c in COLS) for n in nodes}
    assert have == want and len(got.nodes.collect()) == len(nodes)
    assert {(r.node, r.parent, r.role) for r in got.parents.collect()} == links
    assert {(r.node, r.place, r.act) for r in got.other.collect()} == other
    return got, nodes


def test_all_people_against_plain_loops(spark, sf):
    t = tables(spark, sf)
    from pyspark.sql import functions as F

    seeds = t["people"].where("birth_year IS NOT NULL").select(F.col("province").alias("branch"), "given", "surname1", F.col("birth_year").alias("year"), (F.col("birth_year") - 20).alias("lo"), (F.col("birth_year") + 20).alias("hi"), F.lit("").alias("parish"), "place")
    got, nodes = compare(spark, seeds, t["acts"])
    assert {n["state"] for n in nodes} >= {"identified", "doubtful"} and {n["role"] for n in nodes} == {"line", "collateral"}
    by = {r.branch: r for r in R.summary(got).collect()}
    for branch, r in by.items():
        mine = [n for n in nodes if n["branch"] == branch]
        sure = [n["year"] for n in mine if n["role"] == "line" and n["state"] == "identified" and n["year"] is not None]
        assert (r.people, r.line, r.collateral, r.missing, r.year_lo) == (len(mine), sum(n["role"] == "line" for n in mine), sum(n["role"] == "collateral" for n in mine), sum(n["role"] == "line" and n["state"] != "identified" for n in mine), min(sure, default=None))
    assert R.missing_links(got).count() == sum(r.missing for r in by.values())
    kin = R.siblings(got, t["acts"])
    assert kin.count() == sum(r.collateral for r in by.values()) and {r.relation for r in kin.select("relation").distinct().collect()} <= {"sibling", "other_union", "child"}


ACT = "id long, kind string, year int, given string, surname1 string, surname2 string, father_given string, father_surname string, mother_given string, mother_surname string, municipality string, parish string"
SEED = "branch string, given string, surname1 string, year int, lo int, hi int, parish string, place string"


def act(i, year, given, s1, father=("", ""), mother=("", ""), parish="San Juan", kind="bautismo", s2=""):
    return (i, kind, year, given, s1, s2, *father, *mother, "Villa", parish)


@pytest.mark.parametrize("children", [1, 30])
def test_small_family(spark, children):
    eus, ana = ("Eusevio", "Sáez de Torrealba"), ("Ana", "Gil")
    acts = spark.createDataFrame(
        [act(1, 1890, "Blas", "Torrealba", eus, ana), act(2, 1885, "Petra", "Sáez de Torrealba", ("Eusebio", "Torrealba"), ana), act(3, 1893, "Celso", "Torrealba", eus, ("Lucía", "Peñalta")), act(4, 1860, "Eusebio", "Torrealba", ("Zoilo", "Torrealba"), ("", "")),
         act(5, 1861, "Eusebio", "Torrealba", ("Otro", ""), ("", ""), parish="Otra"), act(6, None, "Zoilo", "Torrealba"), act(7, 1890, "Blas", "Torrealba", kind="defuncion"), act(8, 1881, "Eusebio", "Torrealba", eus, ana)], ACT)
    seeds = spark.createDataFrame([("A", "Blas", "Torrealba", 1891, 1871, 1911, "", "Villa"), ("A", "Blas", "Torrealba", 1891, 1871, 1911, "", "Villa"), ("B", "Blas", "Torrealba", 1891, 1871, 1911, "", ""), ("A", "Nadie", "Nunca", 1800, 1780, 1820, "", ""), ("A", "Sin", "", None, None, None, "", ""), ("A", "Sin", "Año", None, None, None, "", ""), ("A", "Muy", "Viejo", 1500, 1480, 1520, "", "")], SEED)
    got, nodes = compare(spark, seeds, acts, children=children)
    state = {(n["branch"], n["given"]): n["state"] for n in nodes}
    assert state["A", "Blas"] == "identified" and state["A", "Zoilo"] == "doubtful" and state["A", "Ana"] == "doubtful" and state["A", "Nadie"] == "no_result" and state["A", "Sin"] == "no_data" and state["A", "Muy"] == "no_result"
    if children == 30:
        relation = {(r.branch, r.node.split("|")[1]): r.relation for r in R.siblings(got, acts).collect()}
        assert relation["A", "petra"] == "sibling" and relation["A", "celso"] == "other_union"


def test_edge_rows(spark):
    acts, seeds = spark.createDataFrame([], ACT), spark.createDataFrame([], SEED)
    assert R.lineage(seeds, acts).nodes.count() == 0
    some = spark.createDataFrame([("A", "Blas", "Gil", 1891, 1871, 1911, None, None)], SEED)
    assert R.lineage(some, acts).nodes.first().state == "no_result"
