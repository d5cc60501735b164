"""Objectives of searches and their queries (row H7 of the inventory)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.operators import objectives as O
from kindred.operators.tables import written

from .names import SURNAME_TOKENS
from .registry import norm, query


def _sql(template: str) -> str:
    return " || ".join(f"nullif({p[1:-1]}, '')" if p.startswith("{") else f"'{p}'" for p in re.split(r"(\{\w+\})", template) if p)


def _forms(s: str) -> str:
    t = SURNAME_TOKENS.replace("surname1", s)
    return f"""CASE WHEN {s} = '' THEN [] WHEN len({t}) <= 1 THEN [{s}, strip_accents({s})] ELSE list_concat(list_concat([{s}, strip_accents({s})], flatten(list_transform({t}, lambda x: [x, strip_accents(x)]))), list_concat([array_to_string({t}, ' '), strip_accents(array_to_string({t}, ' '))],
 CASE WHEN len({t}) = 2 THEN [concat(({t})[1], '-', ({t})[2]), strip_accents(concat(({t})[1], '-', ({t})[2])), concat(({t})[2], ' ', ({t})[1]), strip_accents(concat(({t})[2], ' ', ({t})[1])), concat(({t})[2], '-', ({t})[1])] ELSE [] END)) END"""


NEEDS = {"": "true", "sure": "sure", "!exempt": "NOT exempt"}
TABLE = lambda t: "fm" if "{form}" in t else "mp" if "{prov}" in t else "mu"
OBJECTIVES = f"""WITH n0 AS MATERIALIZED (SELECT seq, concat(given, ' ', surname1) AS name, surname1, surname2, father, mother, spouse, place, province, n_evidence FROM people ),
ok AS (SELECT DISTINCT {norm('name')} AS k FROM n0 WHERE n_evidence > 0),
c AS MATERIALIZED (SELECT a.*, a.province = 'ASIA' AS exempt, father <> '' AND mother <> '' AND {norm('father')} IN (SELECT k FROM ok) AND {norm('mother')} IN (SELECT k FROM ok) AS sure, CASE WHEN a.place <> '' THEN a.place ELSE coalesce((SELECT b.place FROM n0 b WHERE b.seq = a.seq // 2), '') END AS home FROM n0 a),
mu AS MATERIALIZED (SELECT *, home AS mun FROM c WHERE home <> '' UNION ALL SELECT *, 'NATION_13' FROM c WHERE home = 'NATION_3'),
mp AS (SELECT *, province AS prov FROM mu WHERE province <> ''), pv AS (SELECT *, province AS prov FROM c WHERE province <> ''),
fm AS (SELECT *, unnest({_forms('surname1')}) AS form FROM mu UNION ALL SELECT * FROM (SELECT *, unnest({_forms('surname2')}) AS form FROM mu) WHERE {norm('form')} <> {norm('surname1')}),
q AS ({' UNION ALL '.join(f"SELECT seq, {_sql(t)} AS q FROM {TABLE(t)} WHERE {NEEDS[n]}" for t, n in O.PLACE_QUERIES)} UNION ALL {' UNION ALL '.join(f"SELECT seq, {_sql(t)} FROM pv" for t in O.PROVINCE_QUERIES)}
 UNION ALL {' UNION ALL '.join(f"SELECT seq, {_sql(t)} FROM c WHERE home = '' AND province = ''" for t in O.NOWHERE_QUERIES)} UNION ALL {' UNION ALL '.join(f"SELECT seq, {_sql(t)} FROM c" for t in O.PERSON_QUERIES)}),
p AS (SELECT seq, count(*) AS n, sha256(string_agg(q, chr(10) ORDER BY q)) AS fingerprint FROM (SELECT DISTINCT seq, q FROM q WHERE q IS NOT NULL) GROUP BY seq)"""


@query("h7_objectives", f"{OBJECTIVES} SELECT seq, n, fingerprint FROM p QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY seq) = 1")
def h7_objectives(t):
    """Objectives of all people, by given name and first surname; who has no place takes that of the child, one municipality has a second name."""
    p = written(t["people"].withColumn("name", F.concat_ws(" ", "given", "surname1")), "people")
    sure = p.where("n_evidence > 0").select(T.norm("name").alias("k")).distinct()
    ok = lambda c: sure.select(F.col("k").alias(f"{c}_k"), F.lit(True).alias(f"{c}_ok")).hint("merge")
    child = p.where("place <> ''").select(F.explode(F.array(F.col("seq") * 2, F.col("seq") * 2 + 1)).alias("seq"), F.col("place").alias("inherited"))
    c = p.withColumns({"father_k": T.norm("father"), "mother_k": T.norm("mother")}).join(ok("father"), "father_k", "left").join(ok("mother"), "mother_k", "left").join(child.hint("merge"), "seq", "left")
    home = F.when(F.col("place") != "", F.col("place")).otherwise(F.coalesce("inherited", F.lit("")))
    c = c.withColumns({"municipalities": F.array(home, F.when(home == "NATION_3", "NATION_13").otherwise("")), "provinces": F.array("province"), "sure": F.col("father_ok").isNotNull() & F.col("mother_ok").isNotNull() & (F.col("father") != "") & (F.col("mother") != "")})
    return O.objectives(c, ["ASIA"]).select("seq", F.size("queries").cast("long").alias("n"), "fingerprint")
