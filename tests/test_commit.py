"""The commit against plain loops, versions on disk, and edge rows."""

from pyspark.sql import functions as F

from kindred.operators import commit as C
from kindred.sources.files import current_version, read_version

EVENT = "event long, person_id string, kind string, date string, place string, url string"
FINDING = "finding long, person_id string, person string, kind string, quote string, homonym boolean, level string, names array<string>"


def cards(spark, rows):
    full = [(i, n, "", "", state, date, place, "", "", father, mother, "", "") for i, n, state, date, place, father, mother in rows]
    return {**{name: spark.createDataFrame([], ddl) for name, ddl in C.TREE.items()}, "cards": spark.createDataFrame(full, C.TREE["cards"])}


CARDS = [("P1", "Ana Gil Mora", "known", "", "", "", ""), ("P2", "Blas Gil Mora", "confirmed", "1850", "Villa", "Juan Gil", ""), ("P3", "Juan Gil", "known", "", "", "", ""), ("P9", "Sin Nada", "known", "", "", "", "")]
FINDINGS = [
    (1, "P1", "Ana Gil", "Nacimiento", "acta 1", False, "strong", ["Tomás Gil Ruiz (padre)", "Petra Mora (madre)"]),
    (2, "P1", "Ana Gil", "bautismo", "acta 2", False, "confirmed", ["Tomás Gil (padre)"]),
    (3, "P2", "Blas Gil Mora", "bautismo", "acta 3", False, "strong", ["Pedro Gil (padre)", "Petra Mora Sanz (madre)"]),
    (4, None, "Ana Gil Mora", "defuncion", "acta 4", False, "weak", []), (5, None, "Ana Gil Mora", "defuncion", "", False, "strong", []), (6, None, "Ana Gil Mora", "defuncion", "acta 6", True, "strong", []), (7, None, "Gil Ana", "entierro", "acta 7", False, "strong", []),
    (8, None, "Blas  gil MORA", "boda", "acta 8", False, "strong", None),
]
EVENTS = [
    (10, "P1", "nacimiento", "", "Villa", "u10"), (11, "P1", "bautismo", "3 de mayo de 1860", "Otra", "u11"), (12, "P1", "defuncion", "1920", "Villa", "u12"), (13, "P2", "bautismo", "1851", "Otra", "u13"), (14, "P2", "matrimonio", "1880", "Villa", "u14"),
    (15, "P2", "matrimonio", "1880", "Villa", "u14"), (16, "P2", "", "1", "x", "u"), (17, "P2", "bautismo", "1", "x", ""), (18, "P9", "bautismo", "1", "x", "u18"), (19, "P77", "bautismo", "1", "x", "u19"), (20, None, "bautismo", None, None, None),
]


def frames(spark):
    return spark.createDataFrame(EVENTS, EVENT), spark.createDataFrame(FINDINGS, FINDING)


def vouched(spark, tree, events, findings):
    names = tree["cards"].select("id", "name").withColumnRenamed("id", "person_id")
    return C.verifying(events.join(names, "person_id").select("event", "person_id", "name", "kind"), findings)


def test_tiers(spark):
    events, findings = frames(spark)
    got = {r.event: (r.finding, r.tier) for r in vouched(spark, cards(spark, CARDS), events, findings).collect()}
    # by person; by person; alike only, as the findings of that name are weak, unquoted or a namesake's; by person; by name
    assert got == {10: (1, 1), 11: (1, 1), 12: (7, 3), 13: (3, 1), 14: (8, 2), 15: (8, 2), 17: (3, 1)}


def test_commit_and_again(spark):
    events, findings = frames(spark)
    tree = cards(spark, CARDS)
    who = vouched(spark, tree, events, findings)
    after, counts = C.commit(tree, events, who, findings)
    assert counts.first().asDict() == {"changed_cards": 2, "new_cards": 2, "new_evidence": 5, "new_notes": 1}
    got = {r.id: r for r in after["cards"].collect()}
    assert (got["P1"].state, got["P1"].birth_date, got["P1"].birth_place, got["P1"].death_date, got["P1"].father, got["P1"].mother) == ("confirmed", "3 de mayo de 1860", "Villa", "1920", "Tomás Gil Ruiz", "Petra Mora")
    assert (got["P2"].birth_date, got["P2"].father, got["P2"].mother) == ("1850", "Juan Gil", "Petra Mora Sanz") and got["P9"].state == "known"
    # Tomás and the first of the two alike mothers become cards, after the largest number
    assert [(i, got[i].name, got[i].sex, got[i].spouse, got[i].child, got[i].state) for i in ("P10", "P11")] == [("P10", "Tomás Gil Ruiz", "M", "Petra Mora", "Ana Gil Mora", "documented"), ("P11", "Petra Mora", "F", "Tomás Gil Ruiz", "Ana Gil Mora", "documented")]
    assert [tuple(r) for r in after["notes"].collect()] == [("P2", "father", "Pedro Gil", "Juan Gil")]
    assert [tuple(r) for r in after["marriages"].collect()] == [("P2", "1880", "Villa", "u14")]
    assert sorted(r.person_id for r in after["evidence"].collect()) == ["P1", "P1", "P1", "P10", "P11", "P2", "P2"]
    again, counts = C.commit(after, events, who, findings)
    assert set(counts.first().asDict().values()) == {0}
    for name in C.TREE:
        assert sorted(map(tuple, again[name].collect()), key=repr) == sorted(map(tuple, after[name].collect()), key=repr)


def test_first_of_alike_is_the_walk(spark):
    names = ["ana gil", "gil ana mora", "mora gil", "juan", "juan gil ana", "blas", "gil", "mora blas ruiz", "ruiz"]
    kept = []
    for n in names:
        if not any(set(n.split()) <= set(k.split()) or set(k.split()) <= set(n.split()) for k in kept):
            kept.append(n)
    df = spark.createDataFrame([(n, f"{i:03d}") for i, n in enumerate(names)], "k string, at string")
    assert sorted(r.k for r in C.first_of_alike(df).collect()) == sorted(kept) and C.first_of_alike(df.where("false")).count() == 0


def test_versions_are_whole(spark, tmp_path):
    events, findings = frames(spark)
    tree, path = cards(spark, CARDS), f"file://{tmp_path}/tree"
    from kindred.sources.files import new_version

    first = new_version(spark, path, tree)
    counts, second = C.commit_to(spark, path, events, vouched(spark, tree, events, findings), findings)
    assert counts.first().new_evidence == 5 and current_version(spark, path).rstrip("/").endswith(second.rsplit("/", 1)[1])
    # a version without its mark was cut off: readers stay with the one before
    tree["cards"].limit(1).write.parquet(f"{path}/v=99999999999999999999/cards")
    assert current_version(spark, path).rstrip("/").endswith(second.rsplit("/", 1)[1]) and first != second
    counts, _ = C.commit_to(spark, path, events, vouched(spark, tree, events, findings), findings)
    assert counts.first().new_evidence == counts.first().changed_cards == 0
    assert read_version(spark, current_version(spark, path), C.TREE)["cards"].count() == 6


def test_edge_rows(spark):
    events, findings = frames(spark)
    none = {name: spark.createDataFrame([], ddl) for name, ddl in C.TREE.items()}
    who = spark.createDataFrame([], "event long, finding long")
    after, counts = C.commit(none, events, who, findings)
    assert set(counts.first().asDict().values()) == {0} and all(df.count() == 0 for df in after.values())
    assert C.verifying(spark.createDataFrame([], "event long, person_id string, name string, kind string"), findings.where("false")).count() == 0


def test_texts_are_read_once(spark, monkeypatch):
    """The parents that a text names are found once, however many findings say it."""
    from kindred.operators import evidence as E

    read, side = [], E.side
    monkeypatch.setattr(E, "side", lambda df, name: read.append((name, df.count())) or side(df, name))
    events, findings = frames(spark)
    tree = cards(spark, CARDS)
    findings = findings.withColumn("names", F.array(F.lit("Tomás Gil Ruiz (padre)"), F.lit("Petra Mora (madre)")))
    after, _ = C.commit(tree, events, vouched(spark, tree, events, findings), findings)
    got = {r.id: (r.father, r.mother) for r in after["cards"].collect()}
    assert got["P1"] == ("Tomás Gil Ruiz", "Petra Mora") and got["P2"] == ("Juan Gil", "Petra Mora")
    assert read == [("parents-told", 2)]
