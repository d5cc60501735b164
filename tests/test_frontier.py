"""The frontier on a small tree: kinds, keys, priorities, states."""

from kindred.operators import frontier as R

CARD = "id string, seq long, name string, surname string, province string, birth_year int, father string, mother string, sure boolean"
CARDS = [
    ("P1", 1, "Ana Gil Mora", "Gil", "ASIA", 1890, "Juan Gil", "Eva Mora", True), ("P2", 2, "Blas Gil Mora", "Gil", "", 1893, "eva mora", "Juan  Gil", True), ("P3", 3, "Juan Gil", "Gil", "", 1860, "", "", True), ("P4", 4, "Eva Mora Sanz", "Urrunaga", "", 1950, None, None, True),
    ("P5", 5, "Celso Urrunaga", "Urrunaga", "EUROPE", None, "", "", False), ("P6", 6, "Pía Gil", "Gil", "", 1900, "Juan Gil", "Nadie Sabe", True), ("P7", 7, None, "Gil", "", 1900, "", "", False), ("P8", 8, "Leo Gil", "Gil", "", 1901, "Celso Urrunaga", "", True),
]


def test_kinds_and_states(spark):
    own = R.searches(spark.createDataFrame(CARDS, CARD), {"ASIA": 2, "EUROPE": 1})
    got = {r.key: (r.id, r.priority) for r in own.collect()}
    # Ana and Blas are one couple's children; Juan and Eva have no parents to look for
    assert got == {"siblings::eva mora::juan gil": ("P1", 2 + 2 + 1 + 0.5), "person::celso urrunaga": ("P5", 4.5 + 1), "parents::pia gil": ("P6", 2 + 1), "parents::leo gil": ("P8", 2)}
    candidates = spark.createDataFrame([("Nuevo Urrunaga", "Urrunaga", False), ("nuevo urrunaga", "Gil", True), ("Otro Gil", "Gil", True), ("Pía Gil", "Gil", False), ("LEO GIL", "Gil", False), (None, "x", False), ("Visto Gil", "Gil", False)], "name string, surname string, hint boolean")
    prints = spark.createDataFrame([("pia gil", "new"), ("leo gil", "same"), ("visto gil", None), ("celso urrunaga", "p")], "anchor string, print string")
    made = spark.createDataFrame([("parents::pia gil", "old"), ("parents::leo gil", "same"), ("candidate::visto gil", "old"), ("person::ana gil mora", "x"), ("person::ana gil mora", None), ("person::celso urrunaga", None)], "key string, print string")
    rows = {r.key: (r.status, r.priority) for r in R.frontier(own, candidates, prints, made).collect()}
    assert rows == {
        "siblings::eva mora::juan gil": ("queued", 5.5), "person::celso urrunaga": ("omitted", 5.5), "parents::pia gil": ("reopened", 3.0), "parents::leo gil": ("omitted", 2.0), "candidate::nuevo urrunaga": ("queued", 9.5), "candidate::otro gil": ("queued", 2.0),
        "candidate::leo gil": ("queued", 5.0), "candidate::visto gil": ("omitted", 5.0), "person::ana gil mora": ("gone", None),
    }


def test_edge_rows(spark):
    none = spark.createDataFrame([], CARD)
    own = R.searches(none, {})
    assert own.count() == 0
    empty = [spark.createDataFrame([], d) for d in ("name string, surname string, hint boolean", "anchor string, print string", "key string, print string")]
    assert R.frontier(own, *empty).count() == 0
