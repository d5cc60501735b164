"""What classification asks of texts, names and places is asked once for each distinct one."""

from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.operators import evidence as E

NAMES = [None, [], ["Blas Gil (padre)"], ["Blas Gil (padre)", "BLAS  GÍL (es su Padre)", "Ana Gil (madre)"], ["Blas Gil (padre)", "Celso Gil (padre)"], ["no consta (padre)"], [None, "Ana Gil (testigos)"],
         ["hijo de Blas Gil y de Ana Moreno"], ["hijo de Blas Gil y de Ana Moreno", "Otro Gil (padre)"], ["(padre)"], ["Hija legítima de Blas Gil y Ana Moreno; hija de blas gil y Eva Sol", "Ana Moreno (su madre)"]]
QUOTES = [None, "", "Acta 1", "hijo de Celso Gil y de Petra Sol", "hijos de Celso Gil y Petra Sol, hija de Blas Gil y Petra Sol"]


def rows(spark, copies=1):
    some = [(n, q) for n in NAMES for q in QUOTES] * copies
    return spark.createDataFrame([(i, *x) for i, x in enumerate(some)], "id long, names array<string>, quote string")


def test_named_parents(spark):
    df = rows(spark)
    want = {(r.id, k): r[k] for r in df.select("id", T.parent_of("names", "quote", "padre").alias("f"), T.parent_of("names", "quote", "madre").alias("m")).collect() for k in "fm" if r[k] is not None}
    assert want and {(r.id, r.role): r["name"] for r in E.named_parents(df).collect()} == want


def test_texts_are_read_once(spark, monkeypatch):
    read = {}

    def side(df, name):
        read[name] = read.get(name, 0) + df.count()
        return df

    monkeypatch.setattr(E, "side", side)
    got = []
    for copies in (1, 20):
        read.clear()
        assert E.named_parents(rows(spark, copies)).count() > 0
        got.append(read["parents-told"])
    assert got[0] == got[1]


def test_event_class(spark):
    df = spark.createDataFrame([(x,) for x in ("Nacimiento", "BAUTISMO", " bautizó ", "defunción", "Muerte", "boda", "acta de matrimonio", "Censo", "", None)], "k string")
    assert [r[0] for r in df.select(T.event_class("k")).collect()] == ["birth", "birth", "birth", "death", "death", "marriage", "marriage", "censo", "", ""]
    assert df.select(T.event_class(F.lit("birth"))).first()[0] == "birth"


def test_classify_rows(spark):
    """Levels and facts of known and unknown people, with nulls, namesakes and places written differently; names are kept."""
    people = spark.createDataFrame([("P1", "Blas Gil", "Gil", "", 1900, "San Blas", "Celso Gil", "", "", 1), ("P2", "Ana Sol", "Sol", "", None, "", "", "", "", 0)],
                                   "id string, name string, surname1 string, surname2 string, birth_year int, place string, father string, mother string, spouse string, n_evidence int")
    rows = [(1, "Blas Gil", ["Celso Gil (padre)"], "bautismo", "1901", "SAN  BLAS de Asia", "", False), (2, "Blas Gil", None, "bautismo", "1950", None, None, False), (3, "BLAS GIL", [], "defuncion", None, "", "", True),
            (4, "Ana Sol", None, "boda", "1930", "Roma", "", False), (5, "Sol Gil", None, "boda", "1930", "San Blas", "", False), (6, None, None, None, None, None, None, False)]
    findings = spark.createDataFrame(rows, "id long, person string, names array<string>, kind string, fecha string, place string, quote string, homonym boolean")
    got = {r.id: (r.person, r.person_id, r.level, list(r.facts)) for r in E.classify(findings, people).collect()}
    assert got == {1: ("Blas Gil", "P1", "confirmed", ["name", "date", "place", "father"]), 2: ("Blas Gil", "P1", "weak", []), 3: ("BLAS GIL", "P1", "weak", []),
                   4: ("Ana Sol", "P2", "strong", []), 5: ("Sol Gil", None, "strong", []), 6: (None, None, "weak", [])}


def test_cards_are_made_beside_customers(spark, sf):
    """Name parts of acts are found once for each customer, before the join with the orders."""
    from kindred.sources.adapters import _surname, acts, tables

    t = tables(spark, sf)
    orders = acts(False).split("{orders} JOIN ")
    assert len(orders) == 2 and _surname("4 * m + 1", False) in orders[1] and _surname("4 * m + 1", False) not in orders[0]
    a = t["acts"].join(t["orders"], F.expr("id = o_orderkey")).select((F.col("o_custkey") + 1).alias("m"), "father_surname2")
    plain = spark.sql(f"SELECT {_surname('4 * m + 1', False)} AS s, father_surname2 AS t FROM {{a}}", a=a)
    assert plain.where("s = t").count() == plain.count() > 0
