"""Queries over names, dates and predicates (rows B and C of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.operators.tables import written

from .registry import event_class, given_key, norm, query, same_surname, strings, tokens, year_of




@query("b1_normalise", f"SELECT k, count(*) AS n FROM (SELECT {norm('name')} AS k FROM people ) GROUP BY k")
def normalise(t):
    return t["people"].groupBy(T.norm("name").alias("k")).agg(F.count("*").alias("n"))


@query("b2_strip_accents", "SELECT k, count(*) AS n FROM (SELECT strip_accents(name) AS k FROM people ) GROUP BY k")
def strip_accents(t):
    return t["people"].groupBy(T.plain("name").alias("k")).agg(F.count("*").alias("n"))


@query("b3_hashes", "SELECT doc_id, substr(sha256(text), 1, 16) AS short, sha256(concat('doc/', doc_id)) AS url_hash FROM documents")
def hashes(t):
    return t["documents"].select("doc_id", T.short_hash("text").alias("short"), F.sha2(F.concat(F.lit("doc/"), F.col("doc_id")), 256).alias("url_hash"))


@query("b4_years", f"SELECT y, y1500, count(*) AS n FROM (SELECT {year_of('birth_date')} AS y, {year_of('notes', 1500)} AS y1500 FROM people ) GROUP BY ALL")
def years(t):
    return t["people"].groupBy(T.year_of("birth_date").alias("y"), T.year_of("notes", 1500).alias("y1500")).agg(F.count("*").alias("n"))


@query("b5_name_tokens", f"SELECT k, count(*) AS n FROM (SELECT unnest({tokens('name')}) AS k FROM people ) GROUP BY k")
def name_tokens(t):
    return t["people"].select(F.explode(T.name_tokens("name")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


SURNAME_TOKENS = f"list_filter(string_split(trim(surname1), ' '), lambda t: len(t) > 2 AND NOT list_contains({strings(T.PARTICLES)}, strip_accents(lower(t))))"


@query("b6_surname_tokens", f"SELECT k, count(*) AS n FROM (SELECT unnest({SURNAME_TOKENS}) AS k FROM people ) GROUP BY k")
def surname_tokens(t):
    return t["people"].select(F.explode(T.surname_tokens("surname1")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("b7_given_keys", f"SELECT k, count(*) AS n FROM (SELECT {given_key('given')} AS k FROM acts ) GROUP BY k")
def given_keys(t):
    return t["acts"].groupBy(T.given_key("given").alias("k")).agg(F.count("*").alias("n"))


@query("b8_spelling_forms", f"""
WITH s AS (SELECT DISTINCT surname1 AS s, {SURNAME_TOKENS} AS t FROM people ),
f AS (SELECT s, CASE WHEN len(t) <= 1 THEN [s, strip_accents(s)] ELSE list_concat(list_concat([s, strip_accents(s)], flatten(list_transform(t, lambda x: [x, strip_accents(x)]))), list_concat([array_to_string(t, ' '), strip_accents(array_to_string(t, ' '))],
 CASE WHEN len(t) = 2 THEN [concat(t[1], '-', t[2]), strip_accents(concat(t[1], '-', t[2])), concat(t[2], ' ', t[1]), strip_accents(concat(t[2], ' ', t[1])), concat(t[2], '-', t[1])] ELSE [] END)) END AS f FROM s)
SELECT s AS surname, form FROM (SELECT s, unnest(list_distinct(f)) AS form FROM f)""")
def spelling_forms(t):
    return t["people"].select(F.col("surname1").alias("surname")).distinct().select("surname", F.explode(T.spelling_forms("surname")).alias("form"))


@query("b9_wildcards", "SELECT k, count(*) AS n FROM (SELECT regexp_replace(surname1, '[áéíóúüñÁÉÍÓÚÜÑ]', '_', 'g') AS k FROM people ) GROUP BY k")
def wildcards(t):
    return t["people"].groupBy(T.wildcard("surname1").alias("k")).agg(F.count("*").alias("n"))


ROLE = """SELECT id, trim(regexp_extract(x, '(?i)^\\s*([^()]+?)\\s*\\((?:es\\s+)?(?:su\\s+)?(?:{0})\\)', 1)) AS name FROM (SELECT id, unnest(names) AS x FROM findings )"""
BAD = "regexp_matches(name, '(?i)desconocid|ignorad|no consta|sin nombre|padres')"


@query("b10_names_with_role", f"SELECT name, count(DISTINCT id) AS n FROM ({ROLE.format('padre|padres')}) WHERE len(name) >= 3 AND NOT {BAD} GROUP BY name")
def names_with_role(t):
    return t["findings"].select("id", F.explode(T.names_with_role("names", "padre", "padres")).alias("name")).groupBy("name").agg(F.count_distinct("id").alias("n"))


CLAUSE = f"""(SELECT id, regexp_replace(c, '(?i)^.*?\\sde\\s+', '') AS c FROM (SELECT id, regexp_extract(concat('Bautismo de un hijo legítimo de ', regexp_replace(person, '\\s+', ' ', 'g'), ' y de ', regexp_replace(coalesce(names[1], 'Petra Dehesa'), '\\s*\\(.*', ''), ', vecinos'), '(?i)\\bhij(?:os|as|o|a)\\b([^,.;:()\\n]*)', 1) AS c FROM findings ))"""


@query("b11_parent_phrases", f"""SELECT id, father, mother FROM (SELECT id, trim(regexp_extract(c, '(?i)^(.*?)\\s+y\\s+', 1)) AS father, trim(array_to_string(string_split(regexp_replace(regexp_extract(c, '(?i)^.*?\\s+y\\s+(.*)$', 1), '(?i)^de\\s+', ''), ' ')[1:6], ' ')) AS mother FROM {CLAUSE})
WHERE len(father) >= 3 AND len(mother) >= 3 AND NOT {BAD.replace('name', 'father')} AND NOT {BAD.replace('name', 'mother')}""")
def parent_phrases(t):
    quote = t["findings"].select("id", F.concat(F.lit("Bautismo de un hijo legítimo de "), F.regexp_replace("person", r"\s+", " "), F.lit(" y de "), F.regexp_replace(F.coalesce(F.get("names", 0), F.lit("Petra Dehesa")), r"\s*\(.*", ""), F.lit(", vecinos")).alias("q"))
    return quote.select("id", F.explode(T.parent_pairs("q")).alias("p")).select("id", "p.father", "p.mother")


@query("b12_resolve_parent", f"""
WITH r AS ({ROLE.format('padre')}), c AS (SELECT id, count(DISTINCT {norm('name')}) AS k, min(name) AS name FROM r WHERE len(name) >= 3 AND NOT {BAD} GROUP BY id)
SELECT f.id, CASE WHEN k = 1 THEN c.name END AS father FROM findings f LEFT JOIN c ON c.id = f.id""")
def resolve_parent(t):
    return t["findings"].select("id", T.parent_of("names", "quote", "padre").alias("father"))


@query("b13_collaterals", f"""SELECT id, role, name FROM (SELECT DISTINCT id, 'padrino' AS role, name FROM ({ROLE.format('padrino|padrinos')}) UNION ALL SELECT DISTINCT id, 'testigo', name FROM ({ROLE.format('testigo|testigos')})) WHERE len(name) >= 3 AND NOT {BAD}""")
def collaterals(t):
    each = [t["findings"].select("id", F.lit(r).alias("role"), F.explode(T.names_with_role("names", r, r + "s")).alias("name")) for r in ("padrino", "madrina", "testigo")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("b14_event_classes", f"SELECT k, count(*) AS n FROM (SELECT {event_class('kind')} AS k FROM findings ) GROUP BY k")
def event_classes(t):
    return t["findings"].groupBy(T.event_class("kind").alias("k")).agg(F.count("*").alias("n"))


@query("b15_surname_of", "SELECT k, count(*) AS n FROM (SELECT regexp_extract(name, '^\\S+ (.*)$', 1) AS k FROM people ) GROUP BY k")
def surname_of(t):
    return t["people"].groupBy(T.surname_of("name").alias("k")).agg(F.count("*").alias("n"))


RARITY = f"""CASE WHEN {norm('surname1')} = '' OR list_contains({strings(T.COMMON_SURNAMES)}, {norm('surname1')}) THEN 0 WHEN list_has_any(string_split({norm('surname1')}, ' '), {strings(T.COMMON_SURNAMES)}) THEN 1 ELSE 3 END"""


@query("b16_rarity", f"SELECT surname1 AS surname, {RARITY} AS rarity, count(*) AS n FROM people GROUP BY ALL")
def rarities(t):
    return t["people"].groupBy(F.col("surname1").alias("surname")).agg(F.first(T.rarity("surname1")).alias("rarity"), F.count("*").alias("n"))


@query("b17_digitisation", "SELECT p.place, max(CASE WHEN p.province = '' THEN 0 ELSE r.r_regionkey - 1 END) AS points FROM people p LEFT JOIN region r ON r.r_name = p.province GROUP BY p.place")
def digitisation(t):
    scores = t["region"].select(F.col("r_name").alias("province"), (F.col("r_regionkey") - 1).alias("score"))
    return t["people"].join(F.broadcast(scores), "province", "left").groupBy("place").agg(F.max(F.coalesce("score", F.lit(0))).alias("points"))


@query("b18_graph_dates", f"""SELECT k, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(birth_date, '^\\d{{4}}-') THEN concat(CAST(substr(birth_date, 9, 2) AS INT), ' ', {strings(T.MONTHS_OUT)}[CAST(substr(birth_date, 6, 2) AS INT)], ' ', substr(birth_date, 1, 4)) WHEN contains(birth_date, ' de mayo de ') THEN replace(birth_date, ' de mayo de ', ' MAY ') WHEN birth_date = '' THEN '' ELSE concat('ABT ', birth_date) END AS k FROM people ) GROUP BY k""")
def graph_dates(t):
    return t["people"].groupBy(T.graph_date("birth_date").alias("k")).agg(F.count("*").alias("n"))


@query("b20_source_classes", "SELECT CASE WHEN contains(url, 'archivo') THEN 'archive' WHEN contains(url, 'familia') THEN 'family' WHEN contains(url, 'pares') THEN 'state' ELSE 'web' END AS source, count(*) AS n, count(DISTINCT url) AS urls FROM findings GROUP BY 1")
def source_classes(t):
    u = F.col("url")
    kind = F.when(u.contains("archivo"), "archive").when(u.contains("familia"), "family").when(u.contains("pares"), "state").otherwise("web")
    return t["findings"].groupBy(kind.alias("source")).agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"))


KEY = f"concat_ws('|', {norm('kind')}, {norm('fecha')}, {norm('place')}, trim(url), {norm('substr(quote, 1, 400)')}, {norm('precision')})"


@query("b21_evidence_keys", f"SELECT id, sha256({KEY}) AS k FROM findings ")
def evidence_keys(t):
    return t["findings"].select("id", F.sha2(T.evidence_key("kind", "fecha", "place", "url", "quote", "precision"), 256).alias("k"))


PERSON = norm("concat_ws(' ', given, surname1)")
SPOUSE = norm("concat_ws(' ', spouse_given, spouse_surname)")


@query("b22_couple_keys", f"SELECT least(a, b) || '||' || greatest(a, b) AS couple, count(*) AS n, min(k) AS k FROM (SELECT {PERSON} AS a, {SPOUSE} AS b, concat({PERSON}, '::', coalesce(CAST(year AS VARCHAR), '')) AS k FROM acts WHERE kind = 'matrimonio') GROUP BY 1")
def couple_keys(t):
    m = t["acts"].where("kind = 'matrimonio'").select(T.person_key("given", "surname1").alias("a"), T.person_key("spouse_given", "spouse_surname").alias("b"), T.person_key("given", "surname1", "year").alias("k"))
    return m.groupBy(T.pair_key("a", "b").alias("couple")).agg(F.count("*").alias("n"), F.min("k").alias("k"))


@query("b23_citations", "SELECT id, concat_ws(', ', nullif(fonds, ''), CASE WHEN shelfmark <> '' THEN concat('sign. ', shelfmark) END, CASE WHEN folio <> '' THEN concat('f. ', folio) END) AS cite FROM acts ")
def citations(t):
    part = lambda c, p: F.when(F.col(c) != "", F.concat(F.lit(p), F.col(c)))
    return t["acts"].select("id", F.concat_ws(", ", part("fonds", ""), part("shelfmark", "sign. "), part("folio", "f. ")).alias("cite"))


@query("b25_answer_intake", """
WITH a AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN concat('```json', chr(10), '[{"n": ', turn, '}]', chr(10), '```') WHEN (conv_id + turn) % 3 = 1 THEN concat('Result: {"n": ', turn, '} done') ELSE concat('{"n": ', substr(text, 1, 5)) END AS x FROM conversations)
SELECT (conv_id + turn) % 3 <> 2 AS valid, count(*) AS n FROM a GROUP BY 1""")
def answer_intake(t):
    k = (F.col("conv_id") + F.col("turn")) % 3
    x = F.when(k == 0, F.concat(F.lit('```json\n[{"n": '), F.col("turn"), F.lit("}]\n```"))).when(k == 1, F.concat(F.lit('Result: {"n": '), F.col("turn"), F.lit("} done"))).otherwise(F.concat(F.lit('{"n": '), F.substring("text", 1, 5)))
    body = F.regexp_replace(x, r"```(?:json)?", "")
    parsed = F.coalesce(F.try_parse_json(F.nullif(F.regexp_extract(body, r"(?s)(\[.*\])", 1), F.lit(""))), F.try_parse_json(F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit(""))))
    return t["conversations"].groupBy(parsed.isNotNull().alias("valid")).agg(F.count("*").alias("n"))


@query("b26_year_windows", "SELECT id, birth_year - 35 AS parents_lo, birth_year - 18 AS parents_hi, birth_year + 18 AS children_lo, birth_year + 50 AS children_hi, birth_year - 20 AS seed_lo, birth_year + 20 AS seed_hi FROM people WHERE birth_year IS NOT NULL")
def year_windows(t):
    y = F.col("birth_year")
    return t["people"].where(y.isNotNull()).select("id", *[(y + d).alias(n) for n, d in (("parents_lo", -35), ("parents_hi", -18), ("children_lo", 18), ("children_hi", 50), ("seed_lo", -20), ("seed_hi", 20))])


@query("b29_page_fields", r"""
SELECT page_id, lower(regexp_extract(x, '^<a href="([^"]*)">', 1)) AS field, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS x FROM pages) GROUP BY ALL""")
def page_fields(t):
    x = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">[^<]*</a>'), F.lit(1))
    return t["pages"].select("page_id", F.explode(x).alias("x")).groupBy("page_id", F.lower("x").alias("field")).agg(F.count("*").alias("n"))


@query("c1_relevance", f"SELECT doc_id, (len(text) >= 200 AND (contains({norm('text')}, 'password') OR contains({norm('text')}, 'idiot'))) AS relevant FROM documents")
def relevance(t):
    terms = F.array(F.lit("password"), F.lit("idiot"))
    return t["documents"].select("doc_id", ((F.length("text") >= 200) & F.exists(terms, lambda x: F.contains(T.norm("text"), x))).alias("relevant"))


@query("c2_filter_terms", f"""SELECT id, count(DISTINCT term) AS n FROM (SELECT id, {norm('name')} AS term FROM people UNION ALL SELECT id, {norm('place')} FROM people WHERE place <> '' UNION ALL SELECT id, unnest({tokens('name')}) FROM people ) GROUP BY id""")
def filter_terms(t):
    terms = F.array_distinct(F.concat(F.array(T.norm("name")), T.name_tokens("name"), F.filter(F.array(T.norm("place")), lambda x: x != "")))
    return t["people"].select("id", F.size(terms).cast("long").alias("n"))


@query("c3_blocked_domains", """SELECT page_id, (h = '' OR regexp_matches(h, '(^|\\.)example\\.(net|org)$')) AS blocked FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS h FROM pages)""")
def blocked_domains(t):
    """Every suffix of the host against the blocklist, a join on equality."""
    spark = t["pages"].sparkSession
    blocked = spark.createDataFrame([("example.net",), ("example.org",)], "suffix string")
    hosts = t["pages"].select("page_id", F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))).alias("host"))
    parts = F.split("host", r"\.")
    each = hosts.select("page_id", "host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("suffix"))
    hit = each.join(F.broadcast(blocked), "suffix", "left_semi").select("page_id").distinct().withColumn("hit", F.lit(True))
    return hosts.join(hit.hint("merge"), "page_id", "left").select("page_id", ((F.col("host") == "") | F.coalesce("hit", F.lit(False))).alias("blocked"))


@query("c4_manuscript_sources", "SELECT id, (h = 'pares.example.net' OR h LIKE '%.pares.example.net' OR h = 'familia.example.com' OR h LIKE '%.familia.example.com') AS manuscript FROM (SELECT id, regexp_extract(url, '^https?://([^/]+)', 1) AS h FROM findings )")
def manuscript_sources(t):
    h = F.lower(F.try_parse_url("url", F.lit("HOST")))
    is_one = F.lit(False)
    for d in ("pares.example.net", "familia.example.com"):
        is_one = is_one | (h == d) | h.endswith("." + d)
    return t["findings"].select("id", is_one.alias("manuscript"))


@query("c5_same_given", f"WITH a AS (SELECT {given_key('given')} AS k, count(*) AS n FROM acts GROUP BY 1), p AS (SELECT {given_key('given')} AS k, count(*) AS m FROM people GROUP BY 1) SELECT k, n, m FROM a JOIN p USING (k) WHERE k <> ''")
def same_given(t):
    """The predicate is equality of keys, so a hash join decides it."""
    a = t["acts"].groupBy(T.given_key("given").alias("k")).agg(F.count("*").alias("n"))
    p = t["people"].groupBy(T.given_key("given").alias("k")).agg(F.count("*").alias("m"))
    return a.join(p.hint("merge"), "k").where("k <> ''")


def surname_pairs(left, right):
    """Pairs of distinct surnames that are the same under tolerance. Containment is looked for by the
    4-letter pieces of the contained one, an equality join, and then decided in full."""
    def pieces(df, c, out):
        x = F.replace(T.norm(c), F.lit("-"), F.lit(" "))
        return df.select(F.col(c).alias(out), x.alias(out + "_n")).where(x != "").distinct()

    a, b = pieces(left, "surname", "a"), pieces(right, "surname", "b")
    grams = lambda c: F.when(F.length(c) >= 4, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 3), lambda i: F.substring(F.col(c), i, F.lit(4))))).otherwise(F.array(F.col(c)))
    start = lambda c: F.substring(F.col(c), 1, 4)
    within = a.withColumn("g", F.explode(grams("a_n"))).join(b.withColumn("g", start("b_n")).hint("merge"), "g").where(F.contains("a_n", F.col("b_n")))
    around = a.withColumn("g", start("a_n")).join(b.withColumn("g", F.explode(grams("b_n"))).hint("merge"), "g").where(F.contains("b_n", F.col("a_n")))
    both = within.unionByName(around).where((F.col("a_n") == F.col("b_n")) | ((F.length("a_n") >= 4) & (F.length("b_n") >= 4)))
    return both.select("a", "b").distinct()


@query("c6_same_surname", f"WITH p AS (SELECT DISTINCT surname1 AS a FROM people ), q AS (SELECT DISTINCT spouse_surname AS b FROM acts UNION SELECT DISTINCT string_split(surname1, ' ')[1] FROM people ) SELECT a, b FROM p JOIN q ON {same_surname('a', 'b')}")
def same_surname_pairs(t):
    right = t["acts"].select(F.col("spouse_surname").alias("surname")).union(t["people"].select(F.split("surname1", " ")[0])).distinct()
    return surname_pairs(t["people"].select(F.col("surname1").alias("surname")).distinct(), right)


@query("c7_same_place", f"SELECT DISTINCT a.parish, p.place FROM acts a JOIN people p ON {norm('p.place')} <> '' AND {norm('a.parish')} <> '' AND (contains({norm('a.parish')}, {norm('p.place')}) OR contains({norm('p.place')}, {norm('a.parish')}))")
def same_place_pairs(t):
    from kindred.operators.evidence import places_met

    return places_met(t["acts"].select("parish"), "parish", t["people"].select("place"), "place")


#: Parts that the rows of a name are dealt to.
PARTS = 16


@query("c8_names_match", f"""WITH x AS (SELECT id, person, {tokens('person')} AS ta FROM findings ), y AS (SELECT id AS pid, name, {tokens('name')} AS tb FROM people )
SELECT x.id, pid FROM x JOIN y ON {norm('person')} = {norm('name')} OR (len(ta) > 0 AND len(tb) > 0 AND (list_has_all(tb, ta) OR list_has_all(ta, tb)))""")
def names_match_pairs(t):
    from kindred.operators.matching import matching_rows

    a = written(t["findings"].select("id", "person"), "findings")
    return matching_rows(a, "id", "person", written(t["people"].select(F.col("id").alias("pid"), "name"), "people"), "pid", "name", PARTS)


@query("c11_c12_date_fit", f"""WITH d AS (SELECT f.id, {event_class('f.kind')} AS k, {year_of('f.fecha')} - p.birth_year AS d FROM findings f JOIN people p ON {norm('p.name')} = {norm('f.person')})
SELECT id, d, CASE WHEN d IS NULL THEN NULL WHEN k = 'birth' THEN CASE WHEN abs(d) <= 8 THEN 1 ELSE -1 END WHEN k = 'death' THEN CASE WHEN d BETWEEN 0 AND 110 THEN 1 ELSE -1 END WHEN d BETWEEN 6 AND 90 THEN 1 WHEN d < -4 OR d > 110 THEN -1 ELSE 0 END AS fit FROM d""")
def date_fit(t):
    """A row for each finding and card of its name: cards of one name and year are summed, the findings of a name dealt
    to parts, and the rows of summed cards made last, within their row."""
    part = lambda x: F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))) if x is None else F.pmod(F.xxhash64(x), F.lit(PARTS)).cast("int")
    f = t["findings"].select(F.col("id"), "kind", T.year_of("fecha").alias("y"), T.norm("person").alias("k"), part("id").alias("part"))
    p = t["people"].groupBy(T.norm("name").alias("k"), "birth_year").agg(F.count("*").alias("cards")).withColumn("part", part(None))
    each = f.join(p.hint("merge"), ["k", "part"]).select("id", (F.col("y") - F.col("birth_year")).alias("d"), T.date_fit("y", "birth_year", "kind").alias("fit"), "cards")
    return each.select("id", "d", "fit", F.explode(F.sequence(F.lit(1).cast("long"), F.col("cards")))).drop("col")


@query("c13_parent_clash", f"""WITH f AS (SELECT id, {year_of('fecha')} AS y FROM findings ), p AS (SELECT seq, birth_year FROM people ) SELECT f.id, CASE WHEN NOT (y - a.birth_year BETWEEN 13 AND 80) THEN 'father' WHEN NOT (y - b.birth_year BETWEEN 13 AND 55) THEN 'mother' ELSE '' END AS clash FROM f LEFT JOIN p a ON a.seq = f.id LEFT JOIN p b ON b.seq = f.id + 1""")
def parent_clashes(t):
    f = t["findings"].select("id", T.year_of("fecha").alias("y"))
    p = t["people"].select("seq", "birth_year")
    a = p.select(F.col("seq").alias("id"), F.col("birth_year").alias("fb"))
    b = p.select((F.col("seq") - 1).alias("id"), F.col("birth_year").alias("mb"))
    return f.join(a.hint("merge"), "id", "left").join(b.hint("merge"), "id", "left").select("id", T.parent_clash("y", "fb", "mb").alias("clash"))


@query("c14_usable_surnames", f"SELECT surname1 AS surname, count(*) AS n FROM people WHERE len({norm('surname1')}) > 2 AND NOT list_contains({strings(T.COMMON_SURNAMES)}, {norm('surname1')}) GROUP BY 1")
def usable_surnames(t):
    return t["people"].where(T.usable_surname("surname1")).groupBy(F.col("surname1").alias("surname")).agg(F.count("*").alias("n"))


@query("c15_acts_of_person", f"""WITH p AS MATERIALIZED (SELECT id AS person_id, {given_key('given')} AS k, surname1 AS s, birth_year AS y FROM people WHERE birth_year IS NOT NULL), a AS MATERIALIZED (SELECT id, year, {given_key('given')} AS k, surname1 AS s, {given_key('father_given')} AS fk, father_surname AS fs FROM acts ),
m AS (SELECT person_id, id, 0 AS r FROM p JOIN a ON a.k = p.k AND p.k <> '' AND a.year BETWEEN y - 20 AND y + 50 AND {same_surname('a.s', 'p.s')} UNION ALL SELECT person_id, id, 1 FROM p JOIN a ON a.fk = p.k AND p.k <> '' AND a.year BETWEEN y - 20 AND y + 50 AND {same_surname('a.fs', 'p.s')})
SELECT person_id, id, CASE WHEN min(r) = 0 THEN 'self' ELSE 'child' END AS role FROM m GROUP BY person_id, id""")
def acts_of_person(t):
    from kindred.operators.matching import acts_naming

    return acts_naming(t["people"], t["acts"], -20, 50)


@query("c16_branch_members", f"SELECT id FROM people WHERE province IN ('ASIA', 'EUROPE') OR starts_with({norm('place')}, 'nation_1')")
def branch_members(t):
    return t["people"].where(F.col("province").isin("ASIA", "EUROPE") | F.startswith(T.norm("place"), F.lit("nation_1"))).select("id")


#: Elements of a page whose text is left out.
LEFT_OUT = ["script", "style", "nav", "footer", "header", "aside", "form", "noscript", "iframe"]
OUT = "(?is)" + "|".join(f"<{e}\\b.*?</{e}>" for e in LEFT_OUT)


@query("c17_page_kinds", f"""SELECT page_id, CASE WHEN starts_with(html, '%PDF-') THEN 'pdf' WHEN regexp_matches(lower(substr(html, 1, 200)), '<!doctype html|<html') THEN 'html' ELSE 'text' END AS kind, len(t) AS chars, substr(sha256(t), 1, 16) AS hash
FROM (SELECT page_id, html, substr(trim(regexp_replace(regexp_replace(regexp_replace(html, '{OUT}', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 24000) AS t FROM pages)""")
def page_kinds(t):
    """Content kind, and the text of a page cut to 24,000 characters."""
    head = F.lower(F.substring("html", 1, 200))
    body = F.regexp_replace("html", OUT, " ")
    text = F.substring(F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"\s+", " ")), 1, 24000)
    kind = F.when(F.substring("html", 1, 5) == "%PDF-", "pdf").when(head.rlike("<!doctype html|<html"), "html").otherwise("text")
    return t["pages"].select("page_id", kind.alias("kind"), F.length(text).alias("chars"), T.short_hash(text).alias("hash"))


@query("c18_failures", "SELECT CASE WHEN event_type = 'error' AND value < 5 THEN 'timeout' WHEN event_type = 'error' AND value < 15 THEN 'connection' WHEN event_type = 'error' THEN concat('http_', 400 + CAST(user_id % 5 AS INT)) WHEN event_type = 'purchase' AND value > 60 THEN 'too_large' ELSE 'ok' END AS reason, count(*) AS n FROM events GROUP BY 1")
def failures(t):
    e, v = F.col("event_type"), F.col("value")
    reason = (F.when((e == "error") & (v < 5), "timeout").when((e == "error") & (v < 15), "connection").when(e == "error", F.concat(F.lit("http_"), (400 + F.col("user_id") % 5).cast("int").cast("string"))).when((e == "purchase") & (v > 60), "too_large").otherwise("ok"))
    return t["events"].groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("c19_call_errors", """SELECT conv_id, turn, CASE WHEN m IN ('timed out', 'read timeout') THEN 'timeout' WHEN regexp_matches(m, '429|503|rate') THEN 'rate_limit' WHEN regexp_matches(m, '400|422|schema') THEN 'schema' ELSE 'other' END AS kind FROM (SELECT conv_id, turn, ['timed out', 'HTTP 429', 'HTTP 422 schema', '503 rate 400', 'other', 'HTTP 400'][(conv_id * 3 + turn) % 6 + 1] AS m FROM conversations)""")
def call_errors(t):
    m = F.get(F.array(*[F.lit(x) for x in ("timed out", "HTTP 429", "HTTP 422 schema", "503 rate 400", "other", "HTTP 400")]), ((F.col("conv_id") * 3 + F.col("turn")) % 6).cast("int"))
    kind = F.when(m.isin("timed out", "read timeout"), "timeout").when(m.rlike("429|503|rate"), "rate_limit").when(m.rlike("400|422|schema"), "schema").otherwise("other")
    return t["conversations"].select("conv_id", "turn", kind.alias("kind"))


@query("c20_result_lines", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents), f AS (SELECT doc_id, k, line, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM l WHERE contains(lower(line), 'the') AND len(line) > 30 AND len(line) < 300) SELECT doc_id, CAST(k - 1 AS INT) AS pos, line FROM f WHERE r <= 40""")
def result_lines(t):
    """The first 40 useful lines of a text: kept within the row, no shuffle."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    good = F.filter(lines, lambda x: F.contains(F.lower(x["line"]), F.lit("the")) & (F.length(x["line"]) > 30) & (F.length(x["line"]) < 300))
    return t["documents"].select("doc_id", F.explode(F.slice(good, 1, 40)).alias("x")).select("doc_id", "x.pos", "x.line")
