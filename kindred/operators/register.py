"""The upward lineage with a register of people: who is met again is the same node."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import text as T

from .matching import in_window, surname_pairs
from .tables import written

#: Years before a child in which a parent was baptised, and after a person's own year in which the children were.
PARENTS, CHILDREN, ESTIMATE = (35, 18), (18, 50), 28
#: Two mentions whose years are further apart are two people.
SAME_YEARS = 15

NODE = ["branch", "node", "g", "given", "s", "surname2", "year", "estimate", "lo", "hi", "parish", "place", "generation", "role", "state", "act", "confidence", "born", "origin"]
LINE, COLLATERAL = "line", "collateral"


def plain_surname(c: Column | str) -> Column:
    return F.replace(T.norm(c), F.lit("-"), F.lit(" "))


@dataclass
class Lineage:
    """nodes: the register; parents: (branch, node, parent, role) of the line; other: for each node that was
    identified the next five acts (branch, node, place, act)."""

    nodes: DataFrame
    parents: DataFrame
    other: DataFrame


def _joined(arrivals: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(branch, g, s, year, node) of the mentions that a node of the register already is: equal given name, the same
    surname, years not more than SAME_YEARS apart where both are known; of several the oldest, then the smallest."""
    who = arrivals.select("branch", "g", "s", "year").distinct()
    near = F.coalesce(F.abs(F.col("year") - F.col("have")) <= SAME_YEARS, F.lit(True))
    have = nodes.select("branch", "g", F.col("s").alias("t"), F.col("year").alias("have"), "born", "node")
    met = who.join(pairs.hint("merge"), "s").join(have.hint("merge"), ["branch", "g", "t"]).where(near)
    return met.groupBy("branch", "g", "s", "year").agg(F.min(F.struct("born", "node")).alias("m")).select("branch", "g", "s", "year", F.col("m.node").alias("node"))


def _named(rest: DataFrame, pairs: DataFrame, born: int) -> DataFrame:
    """(branch, g, s, year, head, node, y) of mentions that no node is: one new node for each given name and surname (of
    the same ones the shortest, then the smallest) if a mention has no year, else for each SAME_YEARS + 1 years from the first."""
    who = rest.select("branch", "g", "s", "year").distinct()
    names = who.select("branch", "g", "s").distinct()
    head = names.join(pairs.hint("merge"), "s").join(names.select("branch", "g", F.col("s").alias("t")).hint("merge"), ["branch", "g", "t"])
    head = head.groupBy("branch", "g", "s").agg(F.min(F.struct(F.length("t").alias("n"), "t")).alias("m")).select("branch", "g", "s", F.col("m.t").alias("head"))
    each = who.join(head.hint("merge"), ["branch", "g", "s"])
    span = each.groupBy("branch", "g", "head").agg(F.min("year").alias("first"), F.count_if(F.col("year").isNull()).alias("undated"))
    part = F.when(F.col("undated") == 0, F.floor((F.col("year") - F.col("first")) / (SAME_YEARS + 1)))
    each = each.join(span.hint("merge"), ["branch", "g", "head"]).withColumn("part", part)
    year = each.groupBy("branch", "g", "head", "part").agg(F.min("year").alias("y"))
    year = year.withColumn("y", F.when(F.col("part").isNotNull(), F.col("y")))
    same = [F.col("l.branch") == F.col("r.branch"), F.col("l.g") == F.col("r.g"), F.col("l.head") == F.col("r.head"), F.col("l.part").eqNullSafe(F.col("r.part"))]
    both = each.alias("l").join(year.alias("r").hint("merge"), same).select("l.branch", "l.g", "l.s", "l.year", "l.head", "r.y")
    return both.withColumn("node", F.concat_ws("|", "branch", "g", "head", F.coalesce(F.col("y").cast("string"), F.lit("")), F.lit(str(born))))


def _resolved(arrivals: DataFrame, nodes: DataFrame | None, pairs: DataFrame, born: int) -> tuple[DataFrame, DataFrame]:
    """(arrivals with their node, the new nodes)."""
    keys = ["branch", "g", "s", "year"]
    equal = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) if k == "year" else F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in keys]
    old = None if nodes is None else written(_joined(arrivals, nodes, pairs), "met")
    rest = arrivals if old is None else arrivals.alias("l").join(old.alias("r").hint("merge"), equal("l", "r"), "left_anti")
    new = written(_named(rest, pairs, born), "new-names")
    places = new.select(*keys, "node", "y", "head", F.lit(True).alias("is_new"))
    if old is not None:
        places = places.unionByName(old.select(*keys, "node", F.lit(None).cast("int").alias("y"), F.lit("").alias("head"), F.lit(False).alias("is_new")))
    got = written(arrivals.alias("l").join(places.alias("r").hint("merge"), equal("l", "r")).select("l.*", "r.node", "r.y", "r.head", "r.is_new"), "arrived")
    # of the mentions of a new node the line comes before collaterals, then the least generation, year and act
    rest_of = [c for c in NODE if c not in ("node", "branch", "s", "role", "generation", "born", "year", "estimate", "act")]
    first = F.struct((F.col("role") != LINE).alias("c"), "generation", "estimate", "act", *rest_of, "role")
    fresh = got.where("is_new").groupBy("branch", "node", F.col("head").alias("s"), F.col("y").alias("year")).agg(F.min(first).alias("m"))
    fresh = fresh.select("branch", "node", "s", "year", F.lit(born).alias("born"), "m.*").select(NODE)
    return got, fresh


def lineage(seeds: DataFrame, acts: DataFrame, most: int = 14, floor: int = 1550, children: int = 30, rounds: int = 60) -> Lineage:
    """seeds(branch, given, surname1, year, lo, hi, parish, place) walked upwards through the baptisms of acts.

    A round takes all pending nodes of the line at once. Each looks for its own baptism (given name by old spelling,
    the same surname, in its window; points for parish 3, municipality 2 and second surname 2, then nearness to the
    middle of the window, then id). Found, it is `identified` and the parents that its act names come to the next
    generation with the window (year - 35, year - 18) and the act's parish as a hint. Then acts 18 to 50 years after
    its year (else 28 before its child's) that name it as father or mother give collaterals of the generation below,
    the first `children` by id; with such acts but no own it is `doubtful`, else `no_result`. Nodes without name,
    surname or window are `no_data`; those above `most` generations or whose window ends before `floor`, `no_result`.

    Who is met joins the node of the same branch with the same name within SAME_YEARS (see _joined), the mentions of
    a round among themselves as well; a node that ended without an act and is met in one is `identified` by it. A
    node keeps its role and generation, so every node is searched once and the walk ends; more than `rounds` raise."""
    a = acts.where("kind = 'bautismo'").select(
        "id", "year", "given", "surname2", "parish", "municipality", T.given_key("given").alias("k"), plain_surname("surname1").alias("s"), F.col("father_given"), plain_surname("father_surname").alias("fs"),
        F.col("mother_given"), plain_surname("mother_surname").alias("ms"), T.given_key("father_given").alias("fk"), T.given_key("mother_given").alias("mk"))
    a = written(a, "baptisms")
    start = seeds.select(
        "branch", F.lower(F.trim("given")).alias("g"), "given", plain_surname("surname1").alias("s"), F.lit("").alias("surname2"), F.col("year").cast("int").alias("year"), F.col("year").cast("int").alias("estimate"),
        F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"), F.coalesce("parish", F.lit("")).alias("parish"), F.coalesce("place", F.lit("")).alias("place"), F.lit(0).alias("generation"), F.lit(LINE).alias("role"),
        F.lit("pending").alias("state"), F.lit(None).cast("long").alias("act"), F.lit("").alias("confidence"), F.lit("").alias("origin"))
    start = written(start, "seeds")
    every = a.select("s").union(a.select("fs")).union(a.select("ms")).union(start.select("s"))
    pairs = written(surname_pairs(every, every), "surnames")
    named = written(a.select("id", "year", F.explode(F.array(F.struct(F.col("fk").alias("k"), F.col("fs").alias("t")), F.struct(F.col("mk").alias("k"), F.col("ms").alias("t")))).alias("x")).select("id", "year", "x.*").where("k <> '' AND t <> '' AND year IS NOT NULL"), "named")
    # a nameless mention has a node of its own name, so that it is counted and listed
    _, nodes = _resolved(start.where("s <> ''"), None, pairs, 0)
    bare = start.where("s = ''").groupBy("branch", "g").agg(F.min(F.struct(*[c for c in NODE if c not in ("branch", "node", "g", "born")])).alias("m"))
    nodes = written(nodes.unionByName(bare.select("branch", F.concat_ws("|", "branch", "g", F.lit(""), F.lit(""), F.lit("0")).alias("node"), "g", F.lit(0).alias("born"), "m.*").select(NODE)), "register")
    links: list[DataFrame] = []
    other: list[DataFrame] = []
    for turn in range(1, rounds + 1):
        now = nodes.where("state = 'pending'")
        if now.isEmpty():
            break
        bad = F.when(F.col("generation") > most, "no_result").when((F.col("g") == "") | (F.col("s") == "") | F.col("lo").isNull() | F.col("hi").isNull(), "no_data").when(F.col("hi") < floor, "no_result")
        q = written(now.withColumn("bad", bad), "pending")
        go = q.where("bad IS NULL").withColumn("k", T.given_key("given"))
        look = go.select("branch", "node", "k", "s", "surname2", "lo", "hi", "parish", "place").join(pairs.hint("merge"), "s")
        own = a.select("id", F.col("year").alias("y"), "k", F.col("s").alias("t"), F.col("surname2").alias("act2"), T.norm("parish").alias("p"), T.norm("municipality").alias("m"))
        points = F.when((F.col("parish") != "") & (F.col("p") == T.norm("parish")), 3).otherwise(0) + F.when((F.col("place") != "") & (F.col("m") == T.norm("place")), 2).otherwise(0) + F.when((F.col("surname2") != "") & T.same_surname("act2", "surname2"), 2).otherwise(0)
        hits = in_window(look, "lo", "hi", own, "y", ["k", "t"]).select("branch", "node", F.col("id").alias("act"), points.alias("points"), F.abs(F.col("y") - (F.col("lo") + F.col("hi")) / 2).alias("far"))
        ranked = written(_first_n(hits, ["branch", "node"], 6, F.desc("points"), "far", "act"), "own-acts")
        other.append(ranked.where("r > 1").select("branch", "node", (F.col("r") - 1).alias("place"), "act"))
        best = ranked.where("r = 1").select("branch", "node", "act", F.when(F.col("points") >= 3, "high").when(F.col("points") >= 2, "mid").otherwise("low").alias("confidence"))
        mine = a.select(F.col("id").alias("act"), F.col("year").alias("own_year"), F.col("given").alias("own_given"), F.col("surname2").alias("own_s2"), F.col("parish").alias("own_parish"), F.col("municipality").alias("own_place"), "father_given", "fs", "mother_given", "ms")
        found = written(go.drop("act", "confidence").join(best.join(mine.hint("merge"), "act").hint("merge"), ["branch", "node"], "left"), "found")
        # children: by father or mother, an act once a node
        ref = F.coalesce("own_year", "estimate")
        c = found.where(ref.isNotNull()).select("branch", "node", "k", "s", "generation", (ref + CHILDREN[0]).alias("from"), (ref + CHILDREN[1]).alias("to")).join(pairs.hint("merge"), "s")
        kids = in_window(c, "from", "to", named, "year", ["k", "t"]).select("branch", "node", "generation", "id").distinct()
        kids = written(_first_n(kids, ["branch", "node"], children, "id"), "children")
        has = kids.select("branch", "node").distinct().withColumn("has", F.lit(True))
        state = F.when(F.col("act").isNotNull(), "identified").when(F.col("has"), "doubtful").otherwise("no_result")
        took = lambda new, old: F.when(F.col("act").isNotNull() & (F.coalesce(new, F.lit("")) != ""), F.col(new)).otherwise(F.col(old)).alias(old)
        given = F.when(F.col("act").isNotNull() & (F.col("own_given") != ""), F.col("own_given")).otherwise(F.col("given"))
        done = found.join(has.hint("merge"), ["branch", "node"], "left").select(
            "branch", "node", "g", given.alias("given"), "s", took("own_s2", "surname2"), F.when(F.col("act").isNotNull(), F.col("own_year")).otherwise(F.col("year")).alias("year"),
            "estimate", "lo", "hi", took("own_parish", "parish"), took("own_place", "place"), "generation", "role", state.alias("state"), "act", F.coalesce("confidence", F.lit("")).alias("confidence"), "born", "origin")
        done = done.unionByName(q.where("bad IS NOT NULL").withColumn("state", F.col("bad")).select(NODE))
        nodes = written(nodes.where("state <> 'pending'").unionByName(done), "register")
        # who comes: parents of the identified, then children
        up = F.explode(F.array(F.struct(F.lit("father").alias("is"), F.col("father_given").alias("pg"), F.col("fs").alias("ps")), F.struct(F.lit("mother").alias("is"), F.col("mother_given").alias("pg"), F.col("ms").alias("ps")))).alias("x")
        none = lambda kind: F.lit(None).cast(kind)
        parents = found.where("act IS NOT NULL").select("branch", "node", "generation", "own_year", "own_parish", up).where("x.pg <> ''").select(
            "branch", F.lower(F.trim("x.pg")).alias("g"), F.col("x.pg").alias("given"), F.col("x.ps").alias("s"), F.lit("").alias("surname2"), none("int").alias("year"), (F.col("own_year") - ESTIMATE).alias("estimate"),
            (F.col("own_year") - PARENTS[0]).alias("lo"), (F.col("own_year") - PARENTS[1]).alias("hi"), F.coalesce("own_parish", F.lit("")).alias("parish"), F.lit("").alias("place"), (F.col("generation") + 1).alias("generation"), F.lit(LINE).alias("role"),
            F.lit("pending").alias("state"), none("long").alias("act"), F.lit("").alias("confidence"), F.col("node").alias("origin"), F.col("x.is").alias("is"))
        kin = kids.join(a.hint("merge"), "id").select(
            "branch", F.lower(F.trim("given")).alias("g"), "given", "s", "surname2", "year", F.col("year").alias("estimate"), none("int").alias("lo"), none("int").alias("hi"), F.coalesce("parish", F.lit("")).alias("parish"),
            F.coalesce("municipality", F.lit("")).alias("place"), (F.col("generation") - 1).alias("generation"), F.lit(COLLATERAL).alias("role"), F.lit("identified").alias("state"), F.col("id").alias("act"), F.lit("high").alias("confidence"),
            F.col("node").alias("origin"), F.lit("").alias("is"))
        come = written(parents.unionByName(kin), "coming")
        got, fresh = _resolved(come.where("s <> ''"), nodes, pairs, turn)
        links.append(got.where("is <> ''").select("branch", F.col("origin").alias("node"), F.col("node").alias("parent"), F.col("is").alias("role")).distinct())
        # a parent without a surname can't be met again: one node a child
        bare = come.where("s = '' AND role = 'line'").select("branch", F.concat_ws("|", "branch", "g", F.lit(""), "origin").alias("node"), *[c for c in NODE if c not in ("branch", "node", "born")], F.lit(turn).alias("born"), "is")
        links.append(bare.select("branch", F.col("origin").alias("node"), F.col("node").alias("parent"), F.col("is").alias("role")).distinct())
        late = got.where("NOT is_new AND role = 'collateral'").groupBy("branch", "node").agg(F.min("act").alias("seen"))
        ended = F.col("state").isin("doubtful", "no_result", "no_data") & F.col("seen").isNotNull()
        kept = nodes.join(late.hint("merge"), ["branch", "node"], "left").withColumn("act", F.when(ended, F.col("seen")).otherwise(F.col("act"))).withColumn("confidence", F.when(ended, "high").otherwise(F.col("confidence"))).withColumn("state", F.when(ended, "identified").otherwise(F.col("state")))
        nodes = written(kept.select(NODE).unionByName(fresh).unionByName(bare.select(NODE).distinct()), "register")
    else:
        raise RuntimeError(f"people are still pending after {rounds} rounds")
    spark = seeds.sparkSession
    empty = lambda ddl: spark.createDataFrame([], ddl)
    parents, rest = empty("branch string, node string, parent string, role string"), empty("branch string, node string, place int, act long")
    for t in links:
        parents = parents.unionByName(t)
    for t in other:
        rest = rest.unionByName(t)
    return Lineage(nodes, written(parents.distinct(), "line"), written(rest, "other-acts"))


def _first_n(df: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("r") <= n)


def summary(found: Lineage) -> DataFrame:
    """By branch: nodes, of the line, identified, collaterals, missing links, the highest generation and the identified line's years."""
    line = F.col("role") == LINE
    sure = line & (F.col("state") == "identified")
    return found.nodes.groupBy("branch").agg(
        F.count("*").alias("people"), F.count_if(line).alias("line"), F.count_if(sure).alias("identified"), F.count_if(~line).alias("collateral"),
        F.count_if(line & F.col("state").isin("no_result", "doubtful", "no_data")).alias("missing"), F.max(F.when(line, F.col("generation"))).alias("generations"), F.min(F.when(sure, F.col("year"))).alias("year_lo"), F.max(F.when(sure, F.col("year"))).alias("year_hi"))


def missing_links(found: Lineage) -> DataFrame:
    """The line's nodes that no own act closes, with the child through whom they are known."""
    return found.nodes.where("role = 'line' AND state IN ('no_result', 'doubtful', 'no_data')").select("branch", "node", "generation", "state", "lo", "hi", "parish", "origin")


def siblings(found: Lineage, acts: DataFrame) -> DataFrame:
    """branch, node, of, relation of the collaterals: `sibling` of the line's node whose act names the same couple (the
    smallest; given names by old spelling), `other_union` if a parent is of the line but the couple is not, else `child`."""
    part = lambda who: [T.given_key(f"{who}_given").alias(f"{who}_k"), plain_surname(f"{who}_surname").alias(f"{who}_s")]
    both = acts.where("kind = 'bautismo' AND mother_given <> ''").select(F.col("id").alias("act"), *part("father"), *part("mother"))
    known = found.nodes.where("act IS NOT NULL").select("branch", "node", "role", "act").join(both.hint("merge"), "act")
    names = known.select(F.explode(F.array("father_s", "mother_s")).alias("s"))
    pairs = written(surname_pairs(names, names).unionByName(names.where("s = ''").select("s", F.col("s").alias("t")).distinct()), "surnames")
    line = known.where("role = 'line'").groupBy("branch", "father_k", "mother_k", F.col("father_s").alias("father_t"), F.col("mother_s").alias("mother_t")).agg(F.min("node").alias("of"))
    kin = known.where("role = 'collateral'")
    for who in ("father", "mother"):
        kin = kin.join(pairs.withColumnsRenamed({"s": f"{who}_s", "t": f"{who}_t"}).hint("merge"), f"{who}_s")
    line = kin.join(line.hint("merge"), ["branch", "father_k", "mother_k", "father_t", "mother_t"]).groupBy("branch", "node").agg(F.min("of").alias("of"))
    bred = found.parents.groupBy("branch", F.col("parent").alias("origin")).agg(F.min("node").alias("child"))
    out = found.nodes.where("role = 'collateral'").select("branch", "node", "origin").join(line.hint("merge"), ["branch", "node"], "left").join(bred.hint("merge"), ["branch", "origin"], "left")
    return out.select("branch", "node", F.coalesce("of", "origin").alias("of"), F.when(F.col("of").isNotNull(), "sibling").when(F.col("child").isNotNull(), "other_union").otherwise("child").alias("relation"))
