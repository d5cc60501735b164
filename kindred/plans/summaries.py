"""Queries over searches, calls, caches and tables as a whole (rows A, E, F, G, H, J of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.operators.tables import running


from .registry import event_class, norm, query, strings, tokens, year_of




@query("a5_archive_answers", """SELECT id, kind, nullif(shelfmark, '') IS NULL AS blank, year FROM acts WHERE fecha <> ''""")
def a5(t):
    """Answers of an archive as JSON, read back: blank marks are empty, the year is the date's first four digits."""
    raw = t["acts"].select(F.to_json(F.struct("id", "kind", F.when(F.col("shelfmark") == "", "-----").otherwise(F.col("shelfmark")).alias("shelf"), "fecha")).alias("j"))
    x = raw.select(F.from_json("j", "id long, kind string, shelf string, fecha string").alias("x")).select("x.*").where("id IS NOT NULL AND fecha <> ''")
    return x.select("id", "kind", F.coalesce(F.col("shelf").rlike("^-{2,}$"), F.lit(True)).alias("blank"), F.substring("fecha", 1, 4).try_cast("int").alias("year"))


@query("a7_negative_register", "SELECT substr(concat('u', user_id), 1, 120) AS anchor, substr(concat('reason ', props), 1, 300) AS reason, count(*) AS n FROM events WHERE event_type = 'error' AND user_id % 10 <> 0 GROUP BY ALL")
def a7(t):
    e = t["events"].where("event_type = 'error'").select(F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("u"), "user_id")).alias("anchor"), F.concat(F.lit("reason "), "props").alias("reason"))
    return e.where("anchor IS NOT NULL").groupBy(F.substring("anchor", 1, 120).alias("anchor"), F.substring("reason", 1, 300).alias("reason")).agg(F.count("*").alias("n"))


@query("a8_keyed_cache", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, count(*) AS n, min(event_id) AS first FROM events GROUP BY user_id")
def a8(t):
    """Insert-or-ignore keeps the first of a key, replace the last."""
    order = F.struct("ts", "event_id")
    return t["events"].groupBy("user_id").agg(F.max_by("event_type", order).alias("last"), F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("a10_version_retention", "SELECT event_type, event_id, r <= 30 AS keep FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)")
def a10(t):
    """The newest 30 of a type: the newest of 64 parts of it, then of those; ids are unique."""
    newest = [F.desc("ts"), F.desc("event_id")]
    e = t["events"].select("event_type", "event_id", "ts").withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(64)))
    some = e.withColumn("r", F.row_number().over(Window.partitionBy("event_type", "part").orderBy(*newest))).where("r <= 30")
    top = some.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy(*newest))).where("r <= 30").select("event_id", F.lit(True).alias("keep"))
    return e.join(top.hint("merge"), "event_id", "left").select("event_type", "event_id", F.coalesce("keep", F.lit(False)).alias("keep"))


@query("a11_source_table", "SELECT url, min(id) AS first_use, count(*) AS n FROM findings GROUP BY url")
def a11(t):
    return t["findings"].groupBy("url").agg(F.min("id").alias("first_use"), F.count("*").alias("n"))


@query("a12_request_register", f"SELECT DISTINCT {norm('person')} AS k, {event_class('kind')} AS kind FROM findings f WHERE NOT EXISTS (SELECT 1 FROM people p WHERE {norm('p.name')} = {norm('f.person')})")
def a12(t):
    new = t["findings"].select(T.norm("person").alias("k"), T.event_class("kind").alias("kind")).distinct()
    return new.join(t["people"].select(T.norm("name").alias("k")).hint("merge"), "k", "left_anti")


@query("e1_corpus_dedupe", "SELECT h, min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, sha256(concat(source, substr(text, 1, 1000))) AS h FROM documents) GROUP BY h")
def e1(t):
    h = F.sha2(F.concat("source", F.substring("text", 1, 1000)), 256)
    return t["documents"].groupBy(h.alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("e2_surname_frequencies", f"SELECT tok, count(*) AS n FROM (SELECT unnest({tokens('surname1')}) AS tok FROM people UNION ALL SELECT unnest({tokens('surname2')}) FROM people UNION ALL SELECT unnest({tokens("regexp_extract(father, '^\\S+ (.*)$', 1)")}) FROM people WHERE father <> '') GROUP BY tok")
def e2(t):
    p = t["people"]
    each = [p.select(F.explode(T.name_tokens(c)).alias("tok")) for c in ("surname1", "surname2")] + [p.where("father <> ''").select(F.explode(T.name_tokens(T.surname_of("father"))).alias("tok"))]
    return each[0].unionByName(each[1]).unionByName(each[2]).groupBy("tok").agg(F.count("*").alias("n"))


@query("e3_line_years", "SELECT surname1, min(birth_year) AS lo, max(birth_year) AS hi FROM people GROUP BY surname1")
def e3(t):
    return t["people"].groupBy("surname1").agg(F.min("birth_year").alias("lo"), F.max("birth_year").alias("hi"))


@query("e7_corpus_by_origin", "SELECT coalesce(nullif(trim(lower(source)), ''), 'web') AS origin, count(*) AS n, count(*) FILTER (len(text) > 1000) AS long FROM documents GROUP BY 1")
def e7(t):
    return t["documents"].groupBy(F.coalesce(F.nullif(F.trim(F.lower("source")), F.lit("")), F.lit("web")).alias("origin")).agg(F.count("*").alias("n"), F.count_if(F.length("text") > 1000).alias("long"))


@query("e8_tree_depth", "SELECT surname1, count(*) AS cards, count(*) FILTER (n_evidence > 0) AS confirmed, min(birth_year) FILTER (n_evidence > 0) AS oldest, min(birth_year) AS remembered, greatest(0, CAST(round_even((min(birth_year) - 1700) / 28.0, 0) AS INT)) AS left FROM people GROUP BY 1")
def e8(t):
    has = F.col("n_evidence") > 0
    return t["people"].groupBy("surname1").agg(F.count("*").alias("cards"), F.count_if(has).alias("confirmed"), F.min(F.when(has, F.col("birth_year"))).alias("oldest"), F.min("birth_year").alias("remembered"),
                                               F.greatest(F.lit(0), F.bround((F.min("birth_year") - 1700) / 28.0).cast("int")).alias("left"))


@query("e9_negative_by_anchor", "SELECT user_id, count(*) AS attempts, max(ts) AS last, arg_max(props, (ts, event_id)) AS reason FROM events WHERE event_type = 'error' GROUP BY user_id")
def e9(t):
    return t["events"].where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("attempts"), F.max("ts").alias("last"), F.max_by("props", F.struct("ts", "event_id")).alias("reason"))


@query("e10_download_funnel", "SELECT user_id, count(*) AS found, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS fetched, count(*) FILTER (event_type = 'purchase' AND value >= 20) AS passed FROM events GROUP BY user_id")
def e10(t):
    k = F.col("event_type")
    return t["events"].groupBy("user_id").agg(F.count("*").alias("found"), F.count_if(k == "error").alias("failed"), F.count_if(k == "purchase").alias("fetched"), F.count_if((k == "purchase") & (F.col("value") >= 20)).alias("passed"))


CALLS = """calls AS (SELECT conv_id * 100 + turn AS seq, concat('m', conv_id % 3) AS model, CASE WHEN conv_id % 5 = 0 THEN 0 WHEN conv_id % 5 = 1 THEN NULL ELSE len(text) // 4 END AS pt, CASE WHEN conv_id % 5 = 0 THEN 0 WHEN conv_id % 5 = 1 THEN NULL ELSE len(text) // 8 END AS ct, len(text) AS chars, conv_id % 4 = 0 AS image, conv_id % 11 = 3 AS abandoned FROM conversations)"""


def calls(t):
    k = F.col("conv_id") % 5
    usage = lambda d: F.when(k == 0, F.lit(0).cast("long")).when(k != 1, F.floor(F.length("text") / d).cast("long"))
    return t["conversations"].select((F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.concat(F.lit("m"), F.col("conv_id") % 3).alias("model"), usage(4).alias("pt"), usage(8).alias("ct"), F.length("text").alias("chars"), (F.col("conv_id") % 4 == 0).alias("image"), (F.col("conv_id") % 11 == 3).alias("abandoned"))


def priced(t):
    """Calls with tokens (estimated from characters where usage is missing or zero) and cost."""
    missing = F.coalesce("pt", F.lit(0)) + F.coalesce("ct", F.lit(0)) == 0
    pt = F.when(missing | F.col("abandoned"), F.greatest(F.lit(1), F.floor(F.col("chars") / 4)) + F.when(F.col("image"), 1000).otherwise(0)).otherwise(F.col("pt"))
    ct = F.when(F.col("abandoned"), 4096).when(missing, F.floor(F.col("chars") / 8)).otherwise(F.col("ct"))
    return calls(t).withColumns({"estimated": missing, "pt": pt, "ct": ct}).withColumn("cost", F.col("pt") * 1.0 + F.col("ct") * 3.0)


PRICED = CALLS + """, priced AS (SELECT seq, model, abandoned, coalesce(pt, 0) + coalesce(ct, 0) = 0 AS estimated, CASE WHEN coalesce(pt, 0) + coalesce(ct, 0) = 0 OR abandoned THEN greatest(1, chars // 4) + CASE WHEN image THEN 1000 ELSE 0 END ELSE pt END AS pt, CASE WHEN abandoned THEN 4096 WHEN coalesce(pt, 0) + coalesce(ct, 0) = 0 THEN chars // 8 ELSE ct END AS ct FROM calls)"""


@query("e11_cost_ledger", f"WITH {PRICED} SELECT model, abandoned, count(*) AS calls, count(*) FILTER (estimated) AS estimated, CAST(sum(pt) AS BIGINT) AS pt, CAST(sum(ct) AS BIGINT) AS ct, CAST(sum(pt * 1.0 + ct * 3.0) AS DOUBLE) AS cost FROM priced GROUP BY model, abandoned")
def e11(t):
    return priced(t).groupBy("model", "abandoned").agg(F.count("*").alias("calls"), F.count_if("estimated").alias("estimated"), F.sum("pt").cast("long").alias("pt"), F.sum("ct").cast("long").alias("ct"), F.sum("cost").alias("cost"))


@query("e12_active_prices", "SELECT p_brand, max(greatest(p_retailprice, CASE WHEN p_size > 25 THEN p_retailprice * 2 ELSE 0 END)) * 1.1 AS price FROM part GROUP BY p_brand")
def e12(t):
    night = F.when(F.col("p_size") > 25, F.col("p_retailprice") * 2).otherwise(F.lit(0.0))
    return t["part"].groupBy("p_brand").agg((F.max(F.greatest("p_retailprice", night)) * 1.1).alias("price"))


@query("e14_fingerprints", f"SELECT person, sha256(string_agg(k, '::' ORDER BY k)) AS print FROM (SELECT DISTINCT person, concat_ws('|', {norm('person')}, kind, fecha, url) AS k FROM findings ) GROUP BY person")
def e14(t):
    k = F.concat_ws("|", T.norm("person"), "kind", "fecha", "url")
    return t["findings"].groupBy("person").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(k)), "::"), 256).alias("print"))


@query("e17_cache_health", "SELECT CASE WHEN json_valid(j) AND json_array_length(j) > 0 THEN 'with_findings' WHEN json_valid(j) AND doc_id % 4 = 0 THEN 'empty' ELSE 'suspicious' END AS health, count(*) AS n FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '[]' WHEN 1 THEN '[1]' ELSE '[1' END AS j FROM documents) GROUP BY 1")
def e17(t):
    j = F.try_parse_json(F.when(F.col("doc_id") % 3 == 0, "[]").when(F.col("doc_id") % 3 == 1, "[1]").otherwise("[1"))
    health = F.when(F.try_variant_get(j, "$[0]", "int").isNotNull(), "with_findings").when(j.isNotNull() & (F.col("doc_id") % 4 == 0), "empty").otherwise("suspicious")
    return t["documents"].groupBy(health.alias("health")).agg(F.count("*").alias("n"))


@query("e19_catalogue_books", """SELECT page_id, CASE WHEN starts_with(link, '/') THEN 'open' WHEN starts_with(link, '#') THEN 'here' ELSE 'away' END AS state, count(*) AS links, count(DISTINCT link) AS books FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages) GROUP BY ALL""")
def e19(t):
    """Links of listing pages with a range of years and a state, by page."""
    links = t["pages"].select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("link"))
    state = F.when(F.col("link").startswith("/"), "open").when(F.col("link").startswith("#"), "here").otherwise("away")
    return links.groupBy("page_id", state.alias("state")).agg(F.count("*").alias("links"), F.count_distinct("link").alias("books"))


LINK = '<a href="([^"]*)">([^<]*)</a>'


@query("e20_result_rows", f"""WITH x AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS site, regexp_extract_all(html, '{LINK}', 1) AS l, regexp_extract_all(html, '{LINK}', 2) AS t FROM pages)
SELECT page_id, concat(site, l[i]) AS link, CAST(min(i) - 1 AS INT) AS pos, min_by(t[i], i) AS title FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM x) GROUP BY page_id, concat(site, l[i])""")
def e20(t):
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">([^<]*)</a>'), F.lit(1)).alias("link"), F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">([^<]*)</a>'), F.lit(2)).alias("title"))
    rows = t["pages"].select("page_id", F.regexp_extract("url", r"^(https?://[^/]+)", 1).alias("site"), F.posexplode(pairs).alias("pos", "x")).select("page_id", "pos", F.concat("site", "x.link").alias("link"), "x.title")
    return rows.groupBy("page_id", "link").agg(F.min("pos").alias("pos"), F.min_by("title", "pos").alias("title"))


@query("e21_packed_rows", "SELECT municipality, CAST((r - 1) // 12 AS BIGINT) AS pack, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY r) AS ids FROM (SELECT id, municipality, row_number() OVER (PARTITION BY municipality ORDER BY id) AS r FROM acts ) GROUP BY ALL")
def e21(t):
    rows = running(t["acts"].select("id", "municipality"), "municipality", "id", F.lit(1), "r")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"].cast("string")), ",")
    return rows.groupBy("municipality", F.floor((F.col("r") - 1) / 12).alias("pack")).agg(F.count("*").alias("n"), ids.alias("ids"))


@query("e22_requests_by_archive", "SELECT s_nationkey, count(*) AS n, min(s_name) AS first FROM supplier GROUP BY 1")
def e22(t):
    return t["supplier"].groupBy("s_nationkey").agg(F.count("*").alias("n"), F.min("s_name").alias("first"))


@query("e23_ocr_coverage", "SELECT CASE WHEN done IS NULL THEN 'unknown' WHEN done < total THEN 'partial' ELSE 'whole' END AS status, family, count(*) AS n FROM (SELECT CASE WHEN page_id % 9 = 0 THEN NULL ELSE page_id % 5 END AS done, page_id % 7 AS total, CASE WHEN page_id % 2 = 0 THEN 'vision' ELSE 'classic' END AS family FROM pages) GROUP BY ALL")
def e23(t):
    k = F.col("page_id")
    done = F.when(k % 9 != 0, k % 5)
    status = F.when(done.isNull(), "unknown").when(done < k % 7, "partial").otherwise("whole")
    return t["pages"].groupBy(status.alias("status"), F.when(k % 2 == 0, "vision").otherwise("classic").alias("family")).agg(F.count("*").alias("n"))


@query("f3_stable_ids", "SELECT seq, CASE WHEN seq % 3 = 0 THEN seq ELSE (SELECT max(seq) FROM people WHERE seq % 3 = 0) + count(*) FILTER (seq % 3 <> 0) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) END AS id FROM people ")
def f3(t):
    """Numbers for the rows without one, after the largest: ranges of the order are numbered apart and then
    shifted by the sizes of the ranges before, so that no task gets all rows."""
    p = t["people"].select("seq", F.when(F.col("seq") % 3 == 0, F.col("seq")).alias("id"))
    top = p.agg(F.max("id").alias("top")).first().top  # one number, the high-water mark
    new = running(p.where("id IS NULL").select("seq", F.lit(0).alias("all")), "all", "seq", F.lit(1), "r").select("seq", (F.lit(top) + F.col("r")).alias("id"))
    return p.where("id IS NOT NULL").unionByName(new)


@query("f4_budget_stop", f"WITH {PRICED}, r AS (SELECT model, seq, sum(pt * 1.0 + ct * 3.0) OVER (PARTITION BY model ORDER BY seq ROWS UNBOUNDED PRECEDING) AS spent FROM priced) SELECT model, seq, spent >= 20000 AS cut FROM r")
def f4(t):
    return running(priced(t), "model", "seq", F.col("cost"), "spent").select("model", "seq", (F.col("spent") >= 20000).alias("cut"))


def islands(t):
    """Searches with the number of consecutive empty ones that end at each."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t["events"].select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("empty"))
    e = e.withColumn("g", F.sum(F.when(F.col("empty"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.withColumn("run", F.sum(F.when(F.col("empty"), 1).otherwise(0)).over(Window.partitionBy("user_id", "g").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)))


ISLANDS = """e AS (SELECT user_id, event_id, ts, event_type = 'error' AS empty, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
i AS (SELECT *, sum(CAST(empty AS INT)) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)"""


@query("f5_early_stop", f"WITH {ISLANDS} SELECT user_id, arg_min(event_id, (ts, event_id)) AS stop FROM i WHERE run = 3 GROUP BY user_id")
def f5(t):
    return islands(t).where("run = 3").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("stop"))


@query("f6_widening", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'error') WHERE k = 3")
def f6(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t["events"].where("event_type = 'error'").withColumn("k", F.row_number().over(w)).where("k = 3").select("user_id", "event_id")


@query("f7_circuit_breaker", f"WITH {ISLANDS} SELECT user_id, count(*) FILTER (run >= 3) > 0 AS partial, max(run) AS longest FROM i GROUP BY user_id")
def f7(t):
    return islands(t).groupBy("user_id").agg((F.count_if(F.col("run") >= 3) > 0).alias("partial"), F.max("run").alias("longest"))


@query("f8_namesakes", "SELECT id, concat(g, CASE WHEN n > 1 THEN concat(' (', coalesce(CAST(birth_year AS VARCHAR), '?'), ')') ELSE '' END, CASE WHEN k > 1 THEN concat(' #', r) ELSE '' END) AS label FROM (SELECT id, g, birth_year, count(*) OVER (PARTITION BY g) AS n, count(*) OVER (PARTITION BY g, birth_year) AS k, row_number() OVER (PARTITION BY g, birth_year ORDER BY seq) AS r FROM (SELECT id, seq, birth_year, concat(given, ' ', surname1) AS g FROM people ))")
def f8(t):
    p = t["people"].select("id", "seq", "birth_year", F.concat_ws(" ", "given", "surname1").alias("g"))
    same = Window.partitionBy("g", "birth_year")
    p = p.withColumn("n", F.count("*").over(Window.partitionBy("g"))).withColumn("k", F.count("*").over(same)).withColumn("r", F.row_number().over(same.orderBy("seq")))
    year = F.concat(F.lit(" ("), F.coalesce(F.col("birth_year").cast("string"), F.lit("?")), F.lit(")"))
    return p.select("id", F.concat("g", F.when(F.col("n") > 1, year).otherwise(""), F.when(F.col("k") > 1, F.concat(F.lit(" #"), "r")).otherwise("")).alias("label"))


@query("f9_new_per_page", "SELECT user_id, day, count(*) FILTER (r = 1) AS fresh FROM (SELECT user_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, props ORDER BY ts, event_id) AS r FROM events) GROUP BY ALL")
def f9(t):
    first = t["events"].withColumn("r", F.row_number().over(Window.partitionBy("user_id", "props").orderBy("ts", "event_id")))
    return first.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("r") == 1).alias("fresh"))


RARE = f"CASE WHEN list_contains({strings(T.COMMON_SURNAMES)}, {norm('surname1')}) THEN 0 WHEN list_has_any(string_split({norm('surname1')}, ' '), {strings(T.COMMON_SURNAMES)}) THEN 1 ELSE 3 END"


@query("g1_frontier_priority", f"SELECT id, CAST(least(10, 1.5 * {RARE} + CASE province WHEN 'ASIA' THEN 2 WHEN 'EUROPE' THEN 1 ELSE 0 END + CASE WHEN n_evidence > 0 THEN 2 WHEN birth_year IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN birth_year <= 1900 THEN 1 ELSE 0 END) AS DOUBLE) AS priority FROM people ")
def g1(t):
    p = F.col("province")
    score = T.rarity("surname1") * 1.5 + F.when(p == "ASIA", 2).when(p == "EUROPE", 1).otherwise(0) + F.when(F.col("n_evidence") > 0, 2).when(F.col("birth_year").isNotNull(), 1).otherwise(0) + F.when(F.col("birth_year") <= 1900, 1).otherwise(0)
    return t["people"].select("id", F.least(F.lit(10.0), score).alias("priority"))


@query("g2_rows_to_review", "SELECT surname1, id FROM (SELECT surname1, id, row_number() OVER (PARTITION BY surname1 ORDER BY kind <> 'bautismo', municipality <> 'NATION_3', abs(coalesce(year, 0) - 1750), id) AS r FROM acts ) WHERE r <= 15")
def g2(t):
    order = [F.col("kind") != "bautismo", F.col("municipality") != "NATION_3", F.abs(F.coalesce("year", F.lit(0)) - 1750), "id"]
    return t["acts"].withColumn("r", F.row_number().over(Window.partitionBy("surname1").orderBy(*order))).where("r <= 15").select("surname1", "id")


@query("g3_surname_queue", f"SELECT k, CAST(min(prio) AS INT) AS prio, min(id) AS first FROM (SELECT {norm('surname1')} AS k, id, CASE kind WHEN 'bautismo' THEN 1 WHEN 'matrimonio' THEN 2 ELSE 3 END AS prio FROM acts ) GROUP BY k ORDER BY prio, first LIMIT 120")
def g3(t):
    prio = F.when(F.col("kind") == "bautismo", 1).when(F.col("kind") == "matrimonio", 2).otherwise(3)
    return t["acts"].groupBy(T.norm("surname1").alias("k")).agg(F.min(prio).alias("prio"), F.min("id").alias("first")).orderBy("prio", "first").limit(120)


@query("g4_branch_surnames", f"SELECT surname1 AS surname, CAST(row_number() OVER (ORDER BY len(string_split(surname1, ' ')) DESC, len(surname1) DESC, min(seq)) AS INT) AS rank FROM people WHERE len(surname1) > 2 AND NOT list_contains({strings(T.COMMON_SURNAMES)}, {norm('surname1')}) GROUP BY surname1")
def g4(t):
    s = t["people"].where(T.usable_surname("surname1")).groupBy(F.col("surname1").alias("surname")).agg(F.min("seq").alias("seq"))
    return s.select("surname", F.row_number().over(Window.orderBy(F.desc(F.size(F.split("surname", " "))), F.desc(F.length("surname")), "seq")).alias("rank"))


@query("g5_links_per_query", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY first, event_id) AS r FROM (SELECT user_id, min(event_id) AS event_id, min(ts) AS first FROM events WHERE event_type <> 'error' GROUP BY user_id, props)) WHERE r <= 10")
def g5(t):
    hits = t["events"].where("event_type <> 'error'").groupBy("user_id", "props").agg(F.min("event_id").alias("event_id"), F.min("ts").alias("first"))
    return hits.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("first", "event_id"))).where("r <= 10").select("user_id", "event_id")


@query("g7_recent_negative", "WITH e AS (SELECT user_id, count(*) AS n, max(event_id) AS last FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT user_id, n, last FROM e ORDER BY last DESC LIMIT 15")
def g7(t):
    return t["events"].where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last")).orderBy(F.desc("last")).limit(15)


@query("g7_remainder", "WITH e AS (SELECT user_id, count(*) AS n, max(event_id) AS last FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT least(count(*), 15) AS shown, greatest(count(*) - 15, 0) AS more, CAST(sum(n) AS BIGINT) AS attempts FROM e")
def g7_rest(t):
    """How many anchors the list of the newest 15 shows, how many it does not, and all attempts."""
    e = t["events"].where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"))
    return e.agg(F.least(F.count("*"), F.lit(15)).alias("shown"), F.greatest(F.count("*") - 15, F.lit(0)).alias("more"), F.sum("n").alias("attempts"))


@query("h1_union_acts", "SELECT kind, count(*) AS n, min(id) AS lo, max(id) AS hi FROM (SELECT DISTINCT kind, id FROM (SELECT kind, id FROM acts WHERE kind <> 'defuncion' UNION ALL SELECT kind, id FROM acts WHERE kind <> 'bautismo')) GROUP BY kind")
def h1(t):
    a = t["acts"]
    both = a.where("kind <> 'defuncion'").unionByName(a.where("kind <> 'bautismo'")).dropDuplicates(["kind", "id"])
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))


@query("h2_act_surnames", f"SELECT id, count(DISTINCT k) AS n FROM (SELECT id, {norm('unnest([mother_surname, father_surname, surname1, spouse_surname])')} AS k FROM acts ) WHERE len(k) > 2 AND NOT list_contains({strings(T.COMMON_SURNAMES)}, k) GROUP BY id")
def h2(t):
    s = F.array_distinct(F.filter(F.transform(F.array("mother_surname", "father_surname", "surname1", "spouse_surname"), T.norm), lambda x: (F.length(x) > 2) & ~x.isin(T.COMMON_SURNAMES)))
    return t["acts"].select("id", F.size(s).cast("long").alias("n")).where("n > 0")


@query("h3_family_window", "SELECT place, min(birth_year) - 110 AS lo, max(birth_year) + 50 AS hi, count(DISTINCT surname1) AS surnames FROM people GROUP BY place")
def h3(t):
    return t["people"].groupBy("place").agg((F.min("birth_year") - 110).alias("lo"), (F.max("birth_year") + 50).alias("hi"), F.count_distinct("surname1").alias("surnames"))


@query("h4_sources_for", "SELECT p.province, string_agg(DISTINCT s, ',' ORDER BY s) AS sources FROM (SELECT DISTINCT province FROM people ) p, LATERAL (SELECT unnest(['base', CASE WHEN p.province = 'ASIA' THEN 'east' ELSE 'west' END, CASE WHEN p.province = '' THEN 'base' ELSE 'state' END]) AS s) GROUP BY 1")
def h4(t):
    s = F.array(F.lit("base"), F.when(F.col("province") == "ASIA", "east").otherwise("west"), F.when(F.col("province") == "", "base").otherwise("state"))
    return t["people"].select("province").distinct().select("province", F.array_join(F.array_sort(F.array_distinct(s)), ",").alias("sources"))


@query("h5_cache_purge", "SELECT doc_id FROM documents WHERE doc_id % 3 = 2 OR (doc_id % 3 = 0 AND doc_id % 4 <> 0)")
def h5(t):
    j = F.try_parse_json(F.when(F.col("doc_id") % 3 == 0, "[]").when(F.col("doc_id") % 3 == 1, "[1]").otherwise("[1"))
    some = F.try_variant_get(j, "$[0]", "int").isNotNull()
    return t["documents"].where(j.isNull() | (~some & (F.col("doc_id") % 4 != 0))).select("doc_id")


@query("h6_still_to_extract", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def h6(t):
    return t["documents"].select("doc_id").join(t["labels"].where("quality = 1").select("doc_id").hint("merge"), "doc_id", "left_anti")


@query("h7_query_generation", f"SELECT k, count(*) AS n FROM (SELECT DISTINCT concat(kind, ' ', f, ' ', place) AS k FROM (SELECT unnest([surname1, strip_accents(surname1)]) AS f, place FROM people WHERE place <> ''), (SELECT unnest(['censo', 'parroquia', 'padron']) AS kind)) GROUP BY k")
def h7(t):
    forms = t["people"].where("place <> ''").select("place", F.explode(F.array("surname1", T.plain("surname1"))).alias("f")).distinct()
    return forms.select(F.explode(F.transform(F.array(*[F.lit(k) for k in ("censo", "parroquia", "padron")]), lambda k: F.concat_ws(" ", k, "f", "place"))).alias("k")).groupBy("k").agg(F.count("*").alias("n")).select("k", F.lit(1).cast("long").alias("n"))


@query("h8_unpublished_requests", f"SELECT id, place FROM people WHERE coalesce(birth_year, {year_of('notes', 1500)}) >= 1850 AND place <> ''")
def h8(t):
    return t["people"].where((F.coalesce("birth_year", T.year_of("notes", 1500)) >= 1850) & (F.col("place") != "")).select("id", "place")


@query("i15_cycle_progress", "SELECT cycle, evidence, cards, coalesce(cycle = (SELECT min(cycle) FROM (SELECT user_id % 40 AS cycle, count(*) FILTER (event_type = 'signup' AND value > 150) AS c FROM events GROUP BY 1) WHERE cycle >= 2 AND c = 0), false) AS stop FROM (SELECT user_id % 40 AS cycle, count(*) FILTER (event_type = 'signup') AS evidence, count(*) FILTER (event_type = 'signup' AND value > 150) AS cards FROM events GROUP BY 1)")
def i15(t):
    s = F.col("event_type") == "signup"
    c = t["events"].groupBy((F.col("user_id") % 40).alias("cycle")).agg(F.count_if(s).alias("evidence"), F.count_if(s & (F.col("value") > 150)).alias("cards"))
    stop = c.where("cycle >= 2 AND cards = 0").agg(F.min("cycle").alias("at"))
    return c.join(F.broadcast(stop), F.col("cycle") == F.col("at"), "left").select("cycle", "evidence", "cards", F.when(F.lit(True), F.col("at").isNotNull()).alias("stop"))


@query("j2_failure_cooldown", "SELECT event_id, coalesce(ts >= last_fail + INTERVAL 6 HOUR, true) AND NOT coalesce(done, false) AS allowed FROM (SELECT event_id, ts, max(CASE WHEN event_type = 'error' THEN ts END) OVER w AS last_fail, bool_or(event_type = 'purchase') OVER w AS done FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
def j2(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = t["events"].select("event_id", "ts", F.max(F.when(F.col("event_type") == "error", F.col("ts"))).over(w).alias("last"), F.bool_or(F.col("event_type") == "purchase").over(w).alias("done"))
    return e.select("event_id", (F.coalesce(F.col("ts") >= F.col("last") + F.expr("INTERVAL 6 HOURS"), F.lit(True)) & ~F.coalesce("done", F.lit(False))).alias("allowed"))


@query("j3_reopened", f"WITH o AS (SELECT person, sha256(string_agg(k, '::' ORDER BY k)) AS p FROM (SELECT DISTINCT person, concat_ws('|', kind, url) AS k FROM findings WHERE kind <> 'matrimonio') GROUP BY person), n AS (SELECT person, sha256(string_agg(k, '::' ORDER BY k)) AS p FROM (SELECT DISTINCT person, concat_ws('|', kind, url) AS k FROM findings ) GROUP BY person) SELECT o.person FROM o JOIN n USING (person) WHERE o.p <> n.p")
def j3(t):
    def prints(df):
        return df.groupBy("person").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws("|", "kind", "url"))), "::"), 256).alias("p"))

    old, new = prints(t["findings"].where("kind <> 'matrimonio'")), prints(t["findings"])
    return old.join(new.withColumnRenamed("p", "q").hint("merge"), "person").where("p <> q").select("person")


@query("e18_sections", f"SELECT k, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM (SELECT {event_class('kind')} AS k, municipality AS m, id FROM acts ) GROUP BY k, m")
def e18(t):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")
    return t["acts"].groupBy(T.event_class("kind").alias("k"), "municipality").agg(F.count("*").alias("n"), ids.alias("ids")).drop("municipality")


@query("e24_state_overview", "SELECT 'people' AS t, count(*) AS n FROM people UNION ALL SELECT 'acts', count(*) FROM acts UNION ALL SELECT 'findings', count(*) FROM findings UNION ALL SELECT 'documents', count(*) FROM documents")
def e24(t):
    each = [t[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("t"), "n") for n in ("people", "acts", "findings", "documents")]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


@query("i12_commit_fills", f"SELECT p.id, CASE WHEN p.birth_year IS NULL AND f.y IS NOT NULL THEN f.y ELSE p.birth_year END AS birth_year, CASE WHEN p.place = '' THEN coalesce(f.place, '') ELSE p.place END AS place, p.n_evidence + coalesce(f.n, 0) AS n_evidence FROM people p LEFT JOIN (SELECT {norm('person')} AS k, min_by({year_of('fecha')}, id) AS y, min_by(place, id) AS place, count(DISTINCT concat_ws('|', kind, fecha, place, url, quote)) AS n FROM findings WHERE quote <> '' AND NOT homonym AND {event_class('kind')} = 'birth' AND {year_of('fecha')} IS NOT NULL GROUP BY 1) f ON f.k = {norm('p.name')}")
def i12(t):
    """Verified events fill what is empty and never overwrite; evidence is counted by its stable key."""
    y = T.year_of("fecha")
    f = t["findings"].where((F.col("quote") != "") & ~F.col("homonym") & (T.event_class("kind") == "birth") & y.isNotNull())
    f = f.groupBy(T.norm("person").alias("k")).agg(F.min_by(y, "id").alias("y"), F.min_by("place", "id").alias("fp"), F.count_distinct(F.concat_ws("|", "kind", "fecha", "place", "url", "quote")).alias("n"))
    j = t["people"].withColumn("k", T.norm("name")).join(f.hint("merge"), "k", "left")
    return j.select("id", F.coalesce("birth_year", "y").alias("birth_year"), F.when(F.col("place") == "", F.coalesce("fp", F.lit(""))).otherwise(F.col("place")).alias("place"), (F.col("n_evidence") + F.coalesce("n", F.lit(0))).alias("n_evidence"))
