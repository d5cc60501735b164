"""Queries over tables of namesakes: rows as the SQL says, and no operator makes a row for each pair of them."""

import duckdb
import pytest

from kindred.plans import linking, names, registry, research, tree  # noqa: F401

from .harness import connect, differences

#: People, and acts of theirs, who bear one given name and one surname.
N = 400


@pytest.fixture(scope="module")
def namesakes(tmp_path_factory):
    d = tmp_path_factory.mktemp("namesakes")
    con = duckdb.connect()
    # keys that leave 1 by 2, 23 and 31; the spouses that their marriages name are namesakes too
    con.execute(f"CREATE TABLE c AS SELECT 1426 * i + k AS c_custkey, CAST((i + k) % 3 AS INTEGER) AS c_nationkey FROM range({N}) t(i), (SELECT unnest([0, 1, 2]) AS k) WHERE k <> 1 OR i < 20")
    con.execute(f"CREATE TABLE o AS SELECT row_number() OVER (ORDER BY c_custkey, j) AS o_orderkey, c_custkey AS o_custkey FROM c, range(3) r(j)")
    con.execute("CREATE TABLE n AS SELECT CAST(i AS INTEGER) AS n_nationkey, concat('NATION_', i) AS n_name, CAST(i % 2 AS INTEGER) AS n_regionkey FROM (SELECT unnest([0, 1, 2]) AS i)")
    con.execute("CREATE TABLE r AS SELECT CAST(i AS INTEGER) AS r_regionkey, concat('REGION_', i) AS r_name FROM (SELECT unnest([0, 1]) AS i)")
    for t, name in (("c", "customer"), ("o", "orders"), ("n", "nation"), ("r", "region")):
        con.execute(f"COPY {t} TO '{d}/{name}.parquet' (FORMAT PARQUET)")
    return str(d)


def most_rows(df, metric="numOutputRows"):
    """The most rows that an operator of df's last job gave out."""
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        rows = node.metrics().get(metric)
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        inner = node.executedPlan() if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else node.plan() if node.getClass().getSimpleName().endswith("QueryStageExec") else None
        kids = [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
        plan += kids
    return most


BOUNDED = ["d8_named_relative", "c10_same_person", "d9_known_person", "d10_document_people", "d16_index_search", "d1_resolve", "d7_compatibility", "f1_best_person"]


@pytest.mark.parametrize("name", BOUNDED)
def test_no_pairs(spark, namesakes, name):
    df = registry.QUERIES[name](spark, namesakes)
    df.collect()
    # by surname, these two pair the distinct years of either side
    assert 0 < most_rows(df) < N * N / (2 if name in ("d7_compatibility", "f1_best_person") else 4)
    assert differences(spark, connect(namesakes), name, namesakes, registry.QUERIES, registry.SQL) == ""


@pytest.mark.parametrize("name", ["c11_c12_date_fit"])
def test_parts(spark, namesakes, name):
    """The rows of one name are not all one task's."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = registry.QUERIES[name](spark, namesakes).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < sum(sizes) / 2
    assert differences(spark, connect(namesakes), name, namesakes, registry.QUERIES, registry.SQL) == ""


def test_best_acts(spark):
    """The acts that pick_act() and other_acts() take, against every pair."""
    import random

    from kindred.operators.evidence import other_acts, pick_act

    rnd = random.Random(7)
    homes, seconds = ["", "Olmo", "Olmo Alto", "Haya"], ["", "Gil", "Dehesa"]
    people = [(i, "Ana", "Redondal", rnd.choice(seconds), rnd.choice(homes), rnd.choice([1800, 1801, 1803, None])) for i in range(N)]
    acts = [(i, rnd.choice(["bautismo"] * 9 + ["defuncion"]), rnd.choice([None, *range(1793, 1815)]), "Anna", "Redondal", rnd.choice(seconds), rnd.choice(["", "San Juan de Olmo Alto", "San Blas de Haya"]), rnd.choice(homes)) for i in range(N)]
    want = {}
    for seq, _, _, s2, home, born in people:
        near = []
        for i, kind, year, _, _, as2, parish, mun in acts:
            if kind == "bautismo" and born and year and born - 5 <= year <= born + 10:
                points = (3 if home and home in parish else 0) + (2 if mun == home else 0) + (2 if as2 and as2 == s2 else 0)
                near.append((-points, abs(year - (2 * born + 5) / 2), i))
        want[seq] = sorted(near)[:6]
    p = spark.createDataFrame(people, "seq long, given string, surname1 string, surname2 string, place string, birth_year int")
    a = spark.createDataFrame(acts, "id long, kind string, year int, given string, surname1 string, surname2 string, parish string, municipality string")
    best, others = pick_act(p, a, -5, 10), other_acts(p, a, -5, 10)
    assert {(r.seq, r.id, r.points) for r in best.collect()} == {(s, w[0][2], -w[0][0]) for s, w in want.items() if w}
    assert {(r.seq, r.place, r.id) for r in others.collect()} == {(s, k, x[2]) for s, w in want.items() for k, x in enumerate(w) if k}
    assert max(most_rows(best), most_rows(others)) < N * N / 8


@pytest.mark.parametrize("name", ["c15_acts_of_person"])
def test_pairs_not_shuffled(spark, namesakes, name):
    """The result is all pairs; they are made in the last stage."""
    df = registry.QUERIES[name](spark, namesakes)
    rows = len(df.collect())
    assert most_rows(df, "shuffleRecordsWritten") < rows / 2
    assert differences(spark, connect(namesakes), name, namesakes, registry.QUERIES, registry.SQL) == ""


def test_name_pairs_not_shuffled(spark, namesakes):
    """c8: all pairs of rows, made in the last join; names alone are compared and made distinct."""
    df = registry.QUERIES["c8_names_match"](spark, namesakes)
    assert len(df.collect()) > N
    assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert differences(spark, connect(namesakes), "c8_names_match", namesakes, registry.QUERIES, registry.SQL) == ""


def joined_rows(df):
    """The most rows that a join of df's last job gave out."""
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        kind = node.getClass().getSimpleName()
        if kind.endswith("JoinExec"):
            most = max(most, node.metrics().get("numOutputRows").get().value())
        inner = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan() if kind.endswith("QueryStageExec") else None
        plan += [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
    return most


@pytest.mark.parametrize("name", ["c15_acts_of_person"])
def test_arrays_of_acts_meet(spark, namesakes, name):
    """Pairs are made of arrays that the joins meet, not by the joins."""
    df = registry.QUERIES[name](spark, namesakes)
    rows = len(df.collect())
    assert 0 < joined_rows(df) < rows / 20
    assert differences(spark, connect(namesakes), name, namesakes, registry.QUERIES, registry.SQL) == ""


def test_arrays_of_names_meet(spark, namesakes):
    """c8: arrays meet, the cards of a name are repeated only for names with much of the work, which several tasks then share."""
    from kindred.operators import matching

    df = registry.QUERIES["c8_names_match"](spark, namesakes)
    rows = len(df.collect())
    assert 0 < joined_rows(df) < rows / 4
    a = spark.createDataFrame([(i if i else None, "Ana Gil") for i in range(400)] + [(i, f"Petra {chr(97 + i % 26) * 5}") for i in range(400, 500)], "id long, person string")
    b = spark.createDataFrame([(f"P{i}", "Ana Gil Olmo") for i in range(300)] + [(f"P{i}", f"Petra {chr(97 + i % 26) * 5} Olmo") for i in range(300, 400)], "pid string, name string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pairs = matching.matching_rows(a, "id", "person", b, "pid", "name", 16)
        sizes = pairs.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted((r.id or 0, r.pid) for r in pairs.collect())
    assert got == sorted([(i, f"P{j}") for i in range(400) for j in range(300)] + [(i, f"P{j}") for i in range(400, 500) for j in range(300, 400) if i % 26 == j % 26])
    assert max(sizes) < sum(sizes) / 2
