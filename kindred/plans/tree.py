"""Queries that change the tree or answer about it as a whole (more of rows A, D, I of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.operators.branches import closure
from kindred.operators.commit import TREE, commit, verifying
from kindred.operators.families import provisional_people
from kindred.operators.frontier import frontier, searches
from kindred.operators.tables import written

from .linking import LEVELS, d20, levels, resolved
from .registry import event_class, norm, query, strings, tokens

LIKE = "x.k = y.k OR (len(x.t) > 0 AND len(y.t) > 0 AND (list_has_all(x.t, y.t) OR list_has_all(y.t, x.t)))"
VOUCHED = f"""{LEVELS},
vg AS MATERIALIZED (SELECT f.id AS finding, lv.pid, {norm('f.person')} AS k, {tokens('f.person')} AS t, {event_class('f.kind')} AS c FROM findings f JOIN lv USING (id) WHERE f.quote <> '' AND NOT f.homonym AND level <> 'weak'),
ev AS MATERIALIZED (SELECT event, person_id, {norm('name')} AS k, {tokens('name')} AS t, {event_class('kind')} AS c FROM claims ),
t1 AS MATERIALIZED (SELECT event, min(finding) AS finding FROM ev JOIN vg ON vg.pid = ev.person_id AND vg.c = ev.c GROUP BY event),
t2 AS MATERIALIZED (SELECT event, min(finding) AS finding FROM ev JOIN vg ON vg.k = ev.k AND vg.c = ev.c WHERE ev.k <> '' AND event NOT IN (SELECT event FROM t1) GROUP BY event),
e3 AS MATERIALIZED (SELECT * FROM ev WHERE k <> '' AND event NOT IN (SELECT event FROM t1 UNION ALL SELECT event FROM t2)),
al AS MATERIALIZED (SELECT x.k, y.k AS said FROM (SELECT DISTINCT k, t FROM e3) x JOIN (SELECT DISTINCT k, t FROM vg) y ON {LIKE}),
t3 AS MATERIALIZED (SELECT event, min(finding) AS finding FROM e3 JOIN al USING (k) JOIN vg ON vg.k = al.said AND vg.c = e3.c GROUP BY event),
vouched AS MATERIALIZED (SELECT *, 1 AS tier FROM t1 UNION ALL SELECT *, 2 FROM t2 UNION ALL SELECT *, 3 FROM t3)"""


def vouched(t):
    lv = levels(t).select("id", "person_id", "level")
    f = t["findings"].join(lv.hint("merge"), "id").select(F.col("id").alias("finding"), "person_id", "person", "kind", "quote", "homonym", "level")
    return written(verifying(t["claims"].select("event", "person_id", "name", "kind"), f), "vouched")


@query("d15_verifying_tiers", f"{VOUCHED} SELECT event, finding, tier FROM vouched")
def d15_tiers(t):
    return vouched(t)


def key(x: str) -> str:
    return f"concat_ws('|', {norm(x + 'kind')}, {norm(x + 'date')}, {norm(x + 'place')}, trim({x}url), {norm(f'substr({x}quote, 1, 400)')}, 'acta')"


EMPTY = lambda f: f"(coalesce({f}, '') = '')"
FILL = lambda f, c, v: f"min_by({v}, event) FILTER (c = '{c}' AND coalesce({v}, '') <> '') AS f_{f}"
FIELDS = ("birth_date", "birth_place", "death_date", "death_place", "father", "mother")
COMMIT = f"""{VOUCHED},
cd AS MATERIALIZED (SELECT id, name, CASE WHEN n_evidence > 0 THEN 'confirmed' ELSE 'known' END AS state, birth_date, place AS birth_place, '' AS death_date, '' AS death_place, father, mother FROM people ),
d0 AS (SELECT c.event, c.person_id, c.kind, c.fecha AS date, c.place, c.url, f.quote, {event_class('c.kind')} AS c, f.id AS fid FROM claims c JOIN vouched USING (event) JOIN findings f ON f.id = vouched.finding),
e0 AS (SELECT person_id, {key('')} AS key FROM d0 WHERE event % 5 = 0),
dn AS MATERIALIZED (SELECT d.*, {key('d.')} AS key, CASE WHEN c = 'birth' THEN a.name END AS p_father, CASE WHEN c = 'birth' THEN b.name END AS p_mother FROM d0 d LEFT JOIN pq a ON a.id = fid AND a.role = 'f' LEFT JOIN pq b ON b.id = fid AND b.role = 'm' WHERE d.url <> ''),
ne AS MATERIALIZED (SELECT DISTINCT person_id, key FROM dn EXCEPT SELECT person_id, key FROM e0),
fl AS (SELECT person_id, {FILL('birth_date', 'birth', 'date')}, {FILL('birth_place', 'birth', 'place')}, {FILL('death_date', 'death', 'date')}, {FILL('death_place', 'death', 'place')}, {FILL('father', 'birth', 'p_father')}, {FILL('mother', 'birth', 'p_mother')} FROM dn GROUP BY person_id),
wd AS (SELECT DISTINCT person_id, date, place, url FROM dn WHERE c = 'marriage'),
nc AS MATERIALIZED (SELECT id, name, CASE WHEN fl.person_id IS NOT NULL THEN 'confirmed' ELSE state END AS state, {', '.join(f"CASE WHEN {EMPTY(f)} THEN coalesce(f_{f}, '') ELSE {f} END AS {f}" for f in FIELDS)},
 coalesce(id IN (SELECT person_id FROM ne) OR id IN (SELECT person_id FROM wd) OR (fl.person_id IS NOT NULL AND state <> 'confirmed') OR {' OR '.join(f"({EMPTY(f)} AND f_{f} IS NOT NULL)" for f in FIELDS)}, false) AS changed FROM cd LEFT JOIN fl ON fl.person_id = id),
nm AS MATERIALIZED (SELECT x.event, x.person_id, x.role, x.parent, {norm('x.parent')} AS k, CASE x.role WHEN 'father' THEN father ELSE mother END AS known FROM (SELECT event, person_id, 'father' AS role, p_father AS parent FROM dn WHERE p_father IS NOT NULL UNION ALL SELECT event, person_id, 'mother', p_mother FROM dn WHERE p_mother IS NOT NULL) x JOIN nc ON id = person_id),
nt AS MATERIALIZED (SELECT person_id, role, k FROM nm WHERE k <> {norm('known')} GROUP BY ALL),
wa AS MATERIALIZED (SELECT k, min(concat(lpad(CAST(event AS VARCHAR), 20, '0'), role, k)) AS ord FROM nm WHERE k = {norm('known')} GROUP BY k),
un AS MATERIALIZED (SELECT x.k, x.ord, x.t FROM (SELECT k, ord, {tokens('k')} AS t FROM wa) x WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT {norm('name')} AS k, {tokens('name')} AS t FROM cd) y WHERE {LIKE})),
ke AS MATERIALIZED (SELECT unnest(list_reduce(list([{{'k': k, 'ord': ord, 't': t}}] ORDER BY ord), lambda a, b: CASE WHEN len(list_filter(a, lambda y: len(y.t) > 0 AND len(b[1].t) > 0 AND (list_has_all(y.t, b[1].t) OR list_has_all(b[1].t, y.t)))) > 0 THEN a ELSE list_concat(a, b) END), recursive := true) FROM un HAVING count(*) > 0)"""


def tree_of(t, who):
    """The people as a tree; of what the claims say one in five is its evidence already."""
    p = t["people"]
    cards = p.select("id", "name", F.col("surname1").alias("surname"), F.lit("").alias("sex"), F.when(F.col("n_evidence") > 0, "confirmed").otherwise("known").alias("state"), "birth_date", F.col("place").alias("birth_place"), F.lit("").alias("death_date"), F.lit("").alias("death_place"), "father", "mother", "spouse", "child")
    old = claimed(t).where("event % 5 = 0").join(who.hint("merge"), "event").join(t["findings"].select(F.col("id").alias("finding"), "quote").hint("merge"), "finding")
    old = old.withColumn("quote", F.substring("quote", 1, 400)).select("person_id", T.evidence_key("kind", "date", "place", "url", "quote", F.lit("acta")).alias("key"), "kind", "date", "place", "url", "quote")
    spark = p.sparkSession
    return {"cards": cards, "evidence": old, **{n: spark.createDataFrame([], TREE[n]) for n in ("marriages", "notes")}}


def claimed(t):
    return t["claims"].select("event", "person_id", "kind", F.col("fecha").alias("date"), "place", "url")


def committed(t, times):
    who = vouched(t)
    tree, counts = tree_of(t, who), []
    findings = t["findings"].select(F.col("id").alias("finding"), "names", "quote")
    for _ in range(times):
        tree, n = commit(tree, claimed(t), who, findings)
        tree = {name: written(df, name) for name, df in tree.items()}
        counts.append(written(n, "counts"))
    return tree, counts


@query("i12_commit", f"""{COMMIT}, n AS (SELECT (SELECT count(*) FROM nc WHERE changed) AS changed_cards, (SELECT count(*) FROM ke) AS new_cards, (SELECT count(*) FROM ne) AS new_evidence, (SELECT count(*) FROM nt) AS new_notes)
SELECT 1 AS run, * FROM n UNION ALL SELECT 2, 0, 0, 0, 0""")
def i12_commit(t):
    """The counts of a commit and of the same commit again, which finds nothing left to do."""
    _, (first, again) = committed(t, 2)
    return first.select(F.lit(1).alias("run"), "*").unionByName(again.select(F.lit(2).alias("run"), "*"))


@query("i12_cards", f"""{COMMIT} SELECT nc.id, state, {', '.join(FIELDS)}, coalesce(e.n, 0) AS n_evidence, coalesce(m.n, 0) AS n_notes, coalesce(w.n, 0) AS n_marriages FROM nc
 LEFT JOIN (SELECT person_id, count(*) AS n FROM (SELECT person_id, key FROM e0 UNION SELECT person_id, key FROM ne) GROUP BY 1) e ON e.person_id = nc.id LEFT JOIN (SELECT person_id, count(*) AS n FROM nt GROUP BY 1) m ON m.person_id = nc.id LEFT JOIN (SELECT person_id, count(*) AS n FROM wd GROUP BY 1) w ON w.person_id = nc.id
UNION ALL SELECT concat('P', (SELECT max(seq) FROM people ) + row_number() OVER (ORDER BY ord)), 'documented', '', '', '', '', '', '', 1, 0, 0 FROM ke""")
def i12_cards(t):
    """The tree after a commit."""
    tree, _ = committed(t, 1)
    n = lambda name, to: tree[name].distinct().groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias(to)).hint("merge")
    out = tree["cards"].join(n("evidence", "n_evidence"), "id", "left").join(n("notes", "n_notes"), "id", "left").join(n("marriages", "n_marriages"), "id", "left")
    return out.select("id", "state", *FIELDS, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_evidence", "n_notes", "n_marriages")])


@query("i7_branch_closure")
def i7_closure(t):
    """The branch of one municipality, told by given name and first surname as its cards name parents; every second card says no place, as trees do. No SQL (brute force in the tests)."""
    p = t["people"].withColumn("name", F.concat_ws(" ", "given", "surname1"))
    blank = lambda c: F.when(F.col("seq") % 2 == 0, F.col(c)).otherwise("")
    waits = t["findings"].where("homonym").select(F.col("person").alias("name"), F.lit("").alias("province"), "place")
    return closure(p.withColumns({"province": F.lit(""), "place": blank("place")}), waits, [], ["NATION_3"])


FAMILY_OF = f"fk = {norm("concat_ws(' ', father_given, father_surname)")} AND mk = {norm("concat_ws(' ', mother_given, mother_surname)")}"
FULL = lambda r: f"CASE WHEN {r}_given <> '' THEN trim(concat_ws(' ', {r}_given, {r}_surname, {r}_surname2)) ELSE '' END"
PROVISIONAL = f"""WITH b AS MATERIALIZED (SELECT *, {norm("concat_ws(' ', father_given, father_surname)")} AS fk, {norm("concat_ws(' ', mother_given, mother_surname)")} AS mk FROM acts WHERE kind = 'bautismo' AND (father_given <> '' OR mother_given <> '')),
h AS MATERIALIZED (SELECT fk, mk, coalesce(lo, 9999) AS lo, {FULL('father')} AS father, {FULL('mother')} AS mother, father_given, mother_given, father_surname, father_surname2, mother_surname, mother_surname2, municipality FROM (SELECT *, min(year) OVER (PARTITION BY fk, mk) AS lo, row_number() OVER (PARTITION BY fk, mk ORDER BY id) AS r FROM b) WHERE r = 1),
m0 AS MATERIALIZED (SELECT fk AS k, CAST(NULL AS INT) AS y, father AS name, father_surname AS s1, father_surname2 AS s2, municipality, '' AS up_f, '' AS up_m, (lo, father, mother, fk, mk, 0, -1, 0) AS pos FROM h WHERE father_given <> ''
 UNION ALL SELECT mk, NULL, mother, mother_surname, mother_surname2, municipality, '', '', (lo, father, mother, fk, mk, 1, -1, 0) FROM h WHERE mother_given <> ''
 UNION ALL SELECT {norm("concat_ws(' ', b.given, b.surname1)")}, b.year, trim(regexp_replace(concat_ws(' ', b.given, b.surname1, b.surname2), ' +', ' ', 'g')), b.surname1, b.surname2, h.municipality, CASE WHEN h.father_given <> '' THEN fk ELSE '' END, CASE WHEN h.mother_given <> '' THEN mk ELSE '' END, (h.lo, father, mother, fk, mk, 2, coalesce(b.year, -1), b.id) FROM b JOIN h USING (fk, mk) WHERE b.given <> ''),
f0 AS MATERIALIZED (SELECT k, min(y) AS year0 FROM m0 GROUP BY k),
m AS MATERIALIZED (SELECT m0.*, coalesce(y, year0) AS year FROM m0 JOIN f0 USING (k)),
w AS MATERIALIZED (SELECT k, year, min(pos) AS pos, arg_min(name, (-len(string_split(name, ' ')), pos)) AS name, {', '.join(f"coalesce(arg_min({x}, pos) FILTER ({x} <> ''), '') AS {to}" for x, to in (('s1', 'surname1'), ('s2', 'surname2'), ('municipality', 'municipality'), ('up_f', 'up_f'), ('up_m', 'up_m')))}, count(*) AS mentions FROM m GROUP BY k, year),
n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY pos) AS number FROM w),
i AS MATERIALIZED (SELECT *, concat('AV', CASE WHEN number < 1000 THEN lpad(CAST(number AS VARCHAR), 3, '0') ELSE CAST(number AS VARCHAR) END) AS id, count(*) OVER (PARTITION BY name) AS c, row_number() OVER (PARTITION BY name, year ORDER BY number) AS r FROM n),
u AS MATERIALIZED (SELECT i.k, i.id FROM i JOIN f0 ON f0.k = i.k AND i.year IS NOT DISTINCT FROM year0),
d AS (SELECT up, count(*) AS children FROM (SELECT DISTINCT k, year, unnest([up_f, up_m]) AS up FROM m) WHERE up <> '' GROUP BY up)"""


@query("i11_provisional_tree", f"{PROVISIONAL} SELECT number, i.id, i.k, year, concat(name, CASE WHEN c > 1 THEN concat(' (', coalesce(CAST(year AS VARCHAR), '¿?'), CASE WHEN r > 1 THEN concat(' #', r) ELSE '' END, ')') ELSE '' END) AS label, surname1, surname2, municipality, a.id AS father_id, b.id AS mother_id, coalesce(d.children, 0) AS children, mentions FROM i LEFT JOIN u a ON a.k = up_f LEFT JOIN u b ON b.k = up_m LEFT JOIN u o ON o.id = i.id LEFT JOIN d ON d.up = o.k")
def i11_tree(t):
    return provisional_people(t["acts"])


RARE = f"CASE WHEN list_contains({strings(T.COMMON_SURNAMES)}, {norm('surname')}) OR {norm('surname')} = '' THEN 0 WHEN list_has_any(list_filter(string_split({norm('surname')}, ' '), lambda x: NOT list_contains({strings(T.STOPWORDS)}, x)), {strings(T.COMMON_SURNAMES)}) THEN 1 ELSE 3 END"
PRINT = f"SELECT {norm('person')} AS anchor, sha256(string_agg(k, '::' ORDER BY k)) AS print FROM (SELECT DISTINCT person, concat_ws('|', {norm('person')}, kind, fecha, url) AS k FROM findings ) GROUP BY 1"
HINTS = f"""hc AS (SELECT DISTINCT trim(regexp_extract(x, '(?i)^\\s*([^()]+?)\\s*\\((?:padrino|padrinos|testigo|testigos)\\)', 1)) AS name FROM (SELECT unnest(names) AS x FROM findings )),
hi AS (SELECT name FROM hc WHERE len(name) >= 3 AND NOT contains(name, 'no consta') AND {norm("regexp_extract(name, '^\\S+ (.*)$', 1)")} IN (SELECT {norm('surname1')} FROM people ) AND {norm('name')} NOT IN (SELECT {norm('name')} FROM people ))"""
FRONTIER = f"""{LEVELS}, up AS MATERIALIZED (SELECT DISTINCT id, trim(unnest([father, mother])) AS name FROM people ),
un AS (SELECT DISTINCT name AS qid, name, CAST(NULL AS INT) AS year FROM up WHERE name <> ''), {resolved('un', 'u')},
ok AS MATERIALIZED (SELECT qid AS name FROM ures JOIN people p ON p.id = person_id WHERE n_evidence > 0),
pa AS MATERIALIZED (SELECT id, count(*) FILTER (name NOT IN (SELECT name FROM ok)) AS open, string_agg({norm('name')}, '::' ORDER BY {norm('name')}) AS couple FROM up WHERE name <> '' GROUP BY id),
ki AS MATERIALIZED (SELECT p.*, surname1 AS surname, couple, CASE WHEN n_evidence <= 0 THEN 'person' WHEN couple IS NULL THEN NULL WHEN open > 0 THEN 'parents' ELSE 'siblings' END AS what FROM people p LEFT JOIN pa ON pa.id = p.id),
kf AS (SELECT * FROM ki WHERE what IS NOT NULL QUALIFY what <> 'siblings' OR row_number() OVER (PARTITION BY couple, what ORDER BY seq) = 1),
ow AS MATERIALIZED (SELECT concat(what, '::', CASE what WHEN 'siblings' THEN couple ELSE {norm('name')} END) AS key, what AS kind, {norm('name')} AS anchor, id, least(10, 1.5 * {RARE} + CASE province WHEN 'ASIA' THEN 2 WHEN 'EUROPE' THEN 1 ELSE 0 END + CASE WHEN n_evidence > 0 THEN 2 WHEN birth_year IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN birth_year <= 1900 THEN 1 ELSE 0 END + CASE what WHEN 'siblings' THEN 0.5 ELSE 0 END) AS priority FROM kf),
pr AS MATERIALIZED ({PRINT}),
md AS MATERIALIZED (SELECT key, max(coalesce(print, '')) AS old FROM (SELECT concat(unnest(['person::', 'parents::']), {norm('name')}) AS key, CASE WHEN seq % 8 = 0 THEN print ELSE 'before' END AS print FROM people p LEFT JOIN pr ON pr.anchor = {norm('name')} WHERE seq % 4 = 0 UNION ALL SELECT concat('candidate::', anchor), CASE WHEN len(anchor) % 2 = 0 THEN print ELSE 'before' END FROM pr WHERE len(anchor) % 3 = 0) GROUP BY key),
st AS (SELECT ow.*, CASE WHEN old IS NULL THEN 'queued' WHEN old <> '' AND coalesce(print, '') <> '' AND old <> print THEN 'reopened' ELSE 'omitted' END AS status FROM ow LEFT JOIN pr USING (anchor) LEFT JOIN md USING (key)),
{HINTS},
cs AS (SELECT {norm('person')} AS anchor, regexp_extract(person, '^\\S+ (.*)$', 1) AS surname, false AS hint FROM lv WHERE pid IS NULL AND level <> 'weak' UNION ALL SELECT {norm('name')}, regexp_extract(name, '^\\S+ (.*)$', 1), true FROM hi),
ca AS MATERIALIZED (SELECT anchor, min(hint) AS hint, arg_min(surname, (hint, surname)) AS surname FROM cs WHERE anchor <> '' AND anchor NOT IN (SELECT anchor FROM st WHERE status <> 'omitted') GROUP BY anchor),
cq AS (SELECT concat('candidate::', ca.anchor) AS key, 'candidate' AS kind, ca.anchor, CAST(NULL AS VARCHAR) AS id, 1.5 * {RARE} + CASE WHEN hint THEN 2 ELSE 5 END AS priority FROM ca),
cst AS (SELECT cq.*, CASE WHEN old IS NULL THEN 'queued' WHEN old <> '' AND coalesce(print, '') <> '' AND old <> print THEN 'reopened' ELSE 'omitted' END AS status FROM cq LEFT JOIN pr USING (anchor) LEFT JOIN md USING (key)),
al2 AS (SELECT key, kind, anchor, id, CAST(priority AS DOUBLE) AS priority, status FROM st UNION ALL SELECT key, kind, anchor, id, CAST(priority AS DOUBLE), status FROM cst)"""


@query("i14_frontier", f"{FRONTIER} SELECT * FROM al2 UNION ALL SELECT key, split_part(key, '::', 1), NULL, NULL, NULL, 'gone' FROM md WHERE key NOT IN (SELECT key FROM al2)")
def i14_frontier(t):
    """All searches and how they stand. Some were made: for one card in four, half of them with the evidence of now,
    and for some candidates."""
    lv = levels(t)
    p = t["people"]
    own = searches(p.select("id", "seq", "name", F.col("surname1").alias("surname"), "province", "birth_year", "father", "mother", (F.col("n_evidence") > 0).alias("sure")), {"EUROPE": 1, "ASIA": 2})
    k = F.concat_ws("|", T.norm("person"), "kind", "fecha", "url")
    prints = written(t["findings"].groupBy(T.norm("person").alias("anchor")).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(k)), "::"), 256).alias("print")), "prints")
    before = lambda same: F.when(same, F.col("print")).otherwise("before").alias("print")
    cards = p.where("seq % 4 = 0").select("seq", T.norm("name").alias("anchor")).join(prints.hint("merge"), "anchor", "left")
    made = cards.select(F.explode(F.array(F.concat(F.lit("person::"), "anchor"), F.concat(F.lit("parents::"), "anchor"))).alias("key"), before(F.col("seq") % 8 == 0))
    made = made.unionByName(prints.where("length(anchor) % 3 = 0").select(F.concat(F.lit("candidate::"), "anchor").alias("key"), before(F.length("anchor") % 2 == 0)))
    some = lv.where("person_id IS NULL AND level <> 'weak'").select(F.col("person").alias("name"), F.lit(False).alias("hint")).distinct().unionByName(d20(t).withColumn("hint", F.lit(True)))
    rest = F.regexp_extract("name", r"^\S+ (.*)$", 1)
    return frontier(own, some.select("name", rest.alias("surname"), "hint"), prints, made)
