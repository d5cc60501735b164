"""The export's tables on a small tree: numbers, references, edge rows."""

from kindred.operators.export import graph_tables
from kindred.plans import exports

PEOPLE = "id string, seq long, name string, birth_date string, place string"
EDGE = "card string, role string, other string, name string, placeholder boolean"
FINDING = "id long, person_id string, url string, kind string, fecha string"


def test_tables_agree(spark):
    people = spark.createDataFrame([("P9", 1, "Ana", "1890", "Villa"), ("P2", 2, "Blas", "", ""), ("P3", 3, "Eva", None, None), ("P4", 4, "Leo", "", "")], PEOPLE)
    edges = spark.createDataFrame([("P9", "f", "P2", "Blas", False), ("P9", "m", "P3", "Eva", False), ("P4", "f", "P2", "Blas", False), ("P4", "f", "P2", "Blas", False), ("P2", "s", "P3", "Eva", False), ("P3", "s", "P2", "Blas", False), ("P4", "s", "new:pia", "Pía", True), ("P9", "s", "P9", "Ana", False), ("P2", "m", "new:old", "Old", True)], EDGE)
    findings = spark.createDataFrame([(5, "P9", "u2", "boda", "1880-03-12"), (4, None, "u1", "bautismo", ""), (6, "P9", "", "entierro", None), (7, "P2", "u2", "x", "1900")], FINDING)
    t = graph_tables(people, edges, findings)
    rows = {k: sorted(map(tuple, df.collect()), key=repr) for k, df in t.items()}
    assert [(r[0], r[1], r[5]) for r in rows["persons"]] == [("I1", "P9", False), ("I2", "P2", False), ("I3", "P3", False), ("I4", "P4", False), ("I5", "new:old", True), ("I6", "new:pia", True)]
    # Blas and Eva are a family by their child; Blas and his mother's, Leo's and Leo's own follow
    assert rows["families"] == [("F1", "I2", "I3", False), ("F2", None, "I5", False), ("F3", "I2", None, False), ("F4", "I4", "I6", True)]
    assert rows["links"] == [("F1", "child", "I1"), ("F1", "husband", "I2"), ("F1", "wife", "I3"), ("F2", "child", "I2"), ("F2", "wife", "I5"), ("F3", "child", "I4"), ("F3", "husband", "I2"), ("F4", "husband", "I4"), ("F4", "wife", "I6")]
    assert rows["sources"] == [("S1", "u1", 4, 1), ("S2", "u2", 5, 2)]
    assert rows["notes"] == [(5, "I1", "S2", "marriage", "12 MAR 1880"), (6, "I1", None, "death", ""), (7, "I2", "S2", "x", "ABT 1900")]
    empty = graph_tables(people.where("false"), edges.where("false"), findings.where("false"))
    assert all(df.count() == 0 for df in empty.values())


def test_no_reference_dangles(spark, sf):
    from kindred.plans.exports import graph
    from kindred.sources.adapters import tables

    t = {k: df.collect() for k, df in graph(tables(spark, sf)).items()}
    persons, families, sources = ({r.ref for r in t[k]} for k in ("persons", "families", "sources"))
    assert len(persons) == len(t["persons"]) and len(families) == len(t["families"]) and len(sources) == len(t["sources"])
    assert {r.person for r in t["links"]} | {r.person for r in t["notes"]} <= persons and {r.family for r in t["links"]} == families
    assert {x for r in t["families"] for x in (r.husband, r.wife)} - {None} <= persons and {r.source for r in t["notes"]} - {None} <= sources
    assert t["notes"] and t["links"]


def test_tables_alone(spark, monkeypatch):
    """Persons and families are made without reading a finding, notes and sources without numbering families."""
    from kindred.operators import export, tables
    from kindred.plans import registry

    made = []
    write = tables.written
    for module in (export, exports):
        monkeypatch.setattr(module, "written", lambda df, name: made.append(name) or write(df, name))
    for query, never in (("a11_persons", {"findings", "sources", "families"}), ("a11_families", {"findings", "sources"}), ("a11_notes", {"families", "couples"})):
        made.clear()
        assert not registry.QUERIES[query](spark, "/root/testdata/sf0.001").isEmpty()
        assert not never & set(made)
