"""Queries over queues, the gazetteer and prices (more of rows D, E, G of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.operators.places import lookup
from kindred.operators.prices import prices_at, worst_prices
from kindred.operators.queues import EMPTY, admit

from .registry import norm, query, strings

PAIR = norm("concat_ws(' ', surname1, surname2)")
QUEUE = f"""WITH e AS MATERIALIZED (SELECT id, {PAIR} AS k, CASE kind WHEN 'bautismo' THEN 0 WHEN 'matrimonio' THEN 1 ELSE 2 END AS priority, kind FROM acts WHERE len({PAIR}) > 2 AND NOT list_contains({strings(T.COMMON_SURNAMES)}, {PAIR})),
n AS (SELECT k, min(id) AS first, min(id) FILTER (priority < 2) AS urgent FROM e GROUP BY k),
f AS (SELECT min(first) AS full_at FROM (SELECT first, row_number() OVER (ORDER BY first) AS r FROM n) WHERE r = 120),
j AS MATERIALIZED (SELECT k, CASE WHEN full_at IS NULL OR first <= full_at THEN first ELSE urgent END AS since FROM n, f)"""


def surname_events(t):
    """A line's surnames as the acts name them: baptisms first, deaths last."""
    a = t["acts"].withColumn("pair", F.concat_ws(" ", "surname1", "surname2")).where(T.usable_surname("pair"))
    priority = F.when(F.col("kind") == "bautismo", 0).when(F.col("kind") == "matrimonio", 1).otherwise(2)
    return a.select(F.col("id").alias("at"), T.norm("pair").alias("k"), priority.alias("priority"), F.col("kind").alias("source"))


def queued(t):
    return admit(t["acts"].sparkSession.createDataFrame([], EMPTY), surname_events(t))


@query("g3_bounded_queue", f"{QUEUE} SELECT k, CAST(min(priority) AS INT) AS priority, min(since) AS since, string_agg(DISTINCT kind, ',' ORDER BY kind) AS sources FROM e JOIN j USING (k) WHERE id >= since GROUP BY k")
def g3_queue(t):
    return queued(t)[0].select("k", "priority", "since", F.array_join("sources", ",").alias("sources"))


@query("g3_turned_away", f"{QUEUE} SELECT k, count(*) AS n FROM e JOIN j USING (k) WHERE since IS NULL OR id < since GROUP BY k")
def g3_away(t):
    """Events of newcomers that found the queue full, so that a report hides nothing."""
    return queued(t)[1].groupBy("k").agg(F.count("*").alias("n"))


PLACES = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT DISTINCT place, province, {norm('place')} AS k, {norm('province')} AS prov FROM people ),
a0 AS (SELECT {norm('n_name')} AS k, {norm("concat('San 1 de ', n_name)")} AS other FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT {norm("concat('San 1 de ', n_name)")}, {norm("concat('Barrio de ', n_name)")} FROM nation WHERE n_nationkey % 2 = 0),
a1 AS (SELECT k, other FROM a0 UNION SELECT other, k FROM a0),
ac(k, other) AS (SELECT k, other FROM a1 UNION SELECT ac.k, a1.other FROM ac JOIN a1 ON a1.k = ac.other WHERE a1.other <> ac.k),
nm AS (SELECT DISTINCT k, k AS name, 0 AS ord FROM p UNION ALL SELECT k, other, row_number() OVER (PARTITION BY k ORDER BY other) FROM ac WHERE k IN (SELECT k FROM p)),
fo AS MATERIALIZED (SELECT k, form, min(pos) AS pos FROM (SELECT k, name AS form, 2 * ord AS pos FROM nm UNION ALL SELECT k, string_split(name, ' ')[1], 2 * ord + 1 FROM nm) WHERE form <> '' GROUP BY k, form),
g AS MATERIALIZED (SELECT {norm('name')} AS name, {norm('province')} AS prov, count(*) AS n, min(loc) AS first FROM (SELECT name, province, min(id) AS loc FROM (SELECT parish AS name, province, id FROM acts UNION ALL SELECT municipality, province, id FROM acts WHERE folio <> '' AND NOT municipality LIKE '%1' AND NOT municipality LIKE '%6') WHERE name <> '' GROUP BY ALL) GROUP BY 1, 2),
o AS (SELECT {norm('n_name')} AS form, {norm('r_name')} AS prov FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 5 = 0),
q AS MATERIALIZED (SELECT p.k, p.prov, form, pos, p.prov = 'africa' OR EXISTS (SELECT 1 FROM o WHERE o.form = fo.form AND o.prov = p.prov) AS down FROM (SELECT DISTINCT k, prov FROM p) p JOIN fo USING (k)),
h AS (SELECT q.k, q.prov, q.form, q.pos, CAST(sum(g.n) AS BIGINT) AS n, min(g.first) AS first FROM q JOIN g ON NOT down AND starts_with(g.name, q.form) AND contains(g.prov, q.prov) GROUP BY ALL),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY k, prov ORDER BY pos) = 1), s AS (SELECT k, prov, bool_and(down) AS silent FROM q GROUP BY ALL)
SELECT place, province, CASE WHEN b.k IS NOT NULL THEN 'found' WHEN coalesce(silent, p.prov = 'africa') THEN 'unavailable' ELSE 'not_found' END AS status, form, coalesce(n, 0) AS n, first FROM p LEFT JOIN b ON b.k = p.k AND b.prov = p.prov LEFT JOIN s ON s.k = p.k AND s.prov = p.prov"""


@query("d18_gazetteer_lookup", PLACES)
def d18_lookup(t):
    """Places of the people in a gazetteer of the acts' parishes and most municipalities; one province does not answer, nor do some names in theirs."""
    n = t["nation"]
    one, other = F.concat(F.lit("San 1 de "), "n_name"), F.concat(F.lit("Barrio de "), "n_name")
    aliases = n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("k"), one.alias("other")).unionByName(n.where("n_nationkey % 2 = 0").select(one.alias("k"), other.alias("other")))
    a = t["acts"]
    names = a.select(F.col("parish").alias("name"), "province", "id").unionByName(a.where("folio <> '' AND NOT municipality LIKE '%1' AND NOT municipality LIKE '%6'").select(F.col("municipality").alias("name"), "province", "id"))
    gazetteer = names.where("name <> ''").groupBy("name", "province").agg(F.min("id").alias("loc_id"))
    down = n.where("n_nationkey % 5 = 0").join(F.broadcast(t["region"]), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_name").alias("form"), F.col("r_name").alias("province"))
    outages = down.unionByName(n.limit(1).select(F.lit(None).cast("string").alias("form"), F.lit("AFRICA").alias("province")))
    return lookup(t["people"].select("place", "province"), aliases, gazetteer, outages)


NO_CATALOGUE = "p_brand NOT IN ('Brand#3', 'Brand#7')"
PRICES = f"""WITH c AS (SELECT p_brand AS model, max(p_retailprice) AS b_in, max(CAST(p_size AS DOUBLE)) AS b_out FROM part WHERE {NO_CATALOGUE} AND p_size % 9 <> 0 GROUP BY 1),
o AS (SELECT p_brand AS model, p_partkey * 37 % 1440 AS start, (p_partkey * 37 + 60 * (1 + p_size % 10)) % 1440 AS stop, p_retailprice * 2 AS o_in, p_size * 3.0 AS o_out FROM part WHERE {NO_CATALOGUE} AND p_size > 25),
t AS (SELECT p_brand AS model, max(p_size * 0.5) AS t_in, max(p_size * 1.5) AS t_out FROM part WHERE p_brand IN ('Brand#3', 'Brand#4') GROUP BY 1),
e AS (SELECT event_id AS id, concat('Brand#', CAST(user_id % 30 AS VARCHAR)) AS model, hour(ts) * 60 + minute(ts) AS m FROM events)"""
PRICE = lambda p, d: f"CAST(coalesce(greatest(b_{p}, max(o_{p})) * 1.1, t_{p}, {d}) AS DOUBLE) AS price_{p}"


def price_tables(t):
    """Prices of brands: entries without a price for some sizes, dear bands of the day for large parts, a table for a
    brand that the catalogue lacks and for one that it has."""
    p = t["part"]
    listed = p.where(NO_CATALOGUE)
    out = F.when(F.col("p_size") % 9 != 0, F.col("p_size").cast("double"))
    catalogue = listed.select(F.col("p_brand").alias("model"), F.col("p_retailprice").alias("price_in"), out.alias("price_out"))
    start = F.col("p_partkey") * 37
    overrides = listed.where("p_size > 25").select(F.col("p_brand").alias("model"), (start % 1440).cast("int").alias("start"), ((start + 60 * (1 + F.col("p_size") % 10)) % 1440).cast("int").alias("stop"), (F.col("p_retailprice") * 2).alias("price_in"), (F.col("p_size") * 3.0).alias("price_out"))
    table = p.where("p_brand IN ('Brand#3', 'Brand#4')").groupBy(F.col("p_brand").alias("model")).agg(F.max(F.col("p_size") * 0.5).alias("t_in"), F.max(F.col("p_size") * 1.5).alias("t_out"))
    calls = t["events"].select(F.col("event_id").alias("id"), F.concat(F.lit("Brand#"), F.col("user_id") % 30).alias("model"), "ts")
    return calls, catalogue, overrides, table


@query("e12_prices_at", f"{PRICES} SELECT e.id, e.model, {PRICE('in', 1.0)}, {PRICE('out', 3.0)} FROM e LEFT JOIN c ON c.model = e.model LEFT JOIN t ON t.model = e.model LEFT JOIN o ON o.model = e.model AND CASE WHEN stop > start THEN m >= start AND m < stop ELSE m >= start OR m < stop END GROUP BY e.id, e.model, b_in, b_out, t_in, t_out")
def e12_at(t):
    return prices_at(*price_tables(t))


@query("e12_worst_prices", f"{PRICES} SELECT e.model, {PRICE('in', 1.0)}, {PRICE('out', 3.0)} FROM (SELECT DISTINCT model FROM e) e LEFT JOIN c ON c.model = e.model LEFT JOIN t ON t.model = e.model LEFT JOIN o ON o.model = e.model GROUP BY e.model, b_in, b_out, t_in, t_out")
def e12_worst(t):
    calls, *tables = price_tables(t)
    return worst_prices(calls, *tables)
