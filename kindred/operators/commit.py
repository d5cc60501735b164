"""Verified events merged into the tree: a keyed merge that adds nothing when it is run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.sources.files import current_version, new_version, read_version

from .evidence import named_parents
from .matching import subset_pairs
from .tables import running, written

#: The tables of a tree. An evidence's key is that of functions.text.evidence_key; notes are keyed by who disagrees about whom.
TREE = {
    "cards": "id string, name string, surname string, sex string, state string, birth_date string, birth_place string, death_date string, death_place string, father string, mother string, spouse string, child string",
    "evidence": "person_id string, key string, kind string, date string, place string, url string, quote string",
    "marriages": "person_id string, date string, place string, url string",
    "notes": "person_id string, role string, said string, known string",
}


def verifying(events: DataFrame, findings: DataFrame) -> DataFrame:
    """event, finding, tier of events(event, person_id, name, kind): the finding that vouches for each.

    findings(finding, person_id, person, kind, quote, homonym, level) that are quoted, no namesake's and not weak. Tier 1 is
    a finding of the same person and class of event, tier 2 of the same name, tier 3 of a name of which one has the
    other's words; a tier is asked only about events that the tiers before left, and gives the smallest finding.
    Findings are summed to one a person, name or group of names and class first, so no join grows with namesakes."""
    good = written(findings.where((F.col("quote") != "") & ~F.col("homonym") & (F.col("level") != "weak")).select("finding", "person_id", "person", T.norm("person").alias("k"), T.event_class("kind").alias("c")), "good-findings")
    ev = written(events.select("event", "person_id", "name", T.norm("name").alias("k"), T.event_class("kind").alias("c")), "events")
    least = F.min("finding").alias("finding")
    got = ev.join(good.where("person_id IS NOT NULL").groupBy("person_id", "c").agg(least).hint("merge"), ["person_id", "c"]).select("event", "finding", F.lit(1).alias("tier"))
    got = written(got, "tier-1")
    left = ev.join(got.select("event").hint("merge"), "event", "left_anti").where("k <> ''")
    two = written(left.join(good.groupBy("k", "c").agg(least).hint("merge"), ["k", "c"]).select("event", "finding", F.lit(2).alias("tier")), "tier-2")
    left = written(left.join(two.select("event").hint("merge"), "event", "left_anti"), "unverified")
    mine, theirs = left.select(F.col("k").alias("mine")).distinct().withColumn("name", F.col("mine")), good.select(F.col("k").alias("said")).distinct().withColumn("words", F.col("said"))
    alike = subset_pairs(mine, "mine", "name", theirs, "said", "words", True).withColumnRenamed("mine", "k")
    best = alike.join(good.groupBy(F.col("k").alias("said"), "c").agg(least).hint("merge"), "said").groupBy("k", "c").agg(F.min("finding").alias("finding"))
    three = left.join(best.hint("merge"), ["k", "c"]).select("event", "finding", F.lit(3).alias("tier"))
    return got.unionByName(two).unionByName(three)


def first_of_alike(names: DataFrame, rounds: int = 60) -> DataFrame:
    """Of names(k, at) in the order of at, those that a walk would keep which leaves out each name that is alike (the words
    of one are in the other) to one that it kept. A round decides all names before which no undecided one is alike."""
    pairs = subset_pairs(names.select(F.col("k").alias("mine"), F.col("k").alias("n")), "mine", "n", names.select(F.col("k").alias("other"), F.col("k").alias("m")), "other", "m", True)
    pairs = pairs.withColumnRenamed("mine", "k").where("k <> other").join(names.hint("merge"), "k").join(names.withColumnsRenamed({"k": "other", "at": "before"}).hint("merge"), "other").where("before < at").select("k", "other").distinct()
    pairs = written(pairs, "alike")
    open_, kept = written(names, "undecided"), names.limit(0)
    for _ in range(rounds):
        if open_.isEmpty():
            return kept
        stays = written(open_.join(pairs.select("k").distinct().hint("merge"), "k", "left_anti"), "kept")
        gone = pairs.join(stays.select(F.col("k").alias("other")).hint("merge"), "other", "left_semi").select("k").distinct()
        kept = kept.unionByName(stays)
        decided = written(stays.select("k").unionByName(gone), "decided")
        open_ = written(open_.join(decided.hint("merge"), "k", "left_anti"), "undecided")
        pairs = written(pairs.join(decided.hint("merge"), "k", "left_anti").join(decided.select(F.col("k").alias("other")).hint("merge"), "other", "left_anti"), "alike")
    raise RuntimeError(f"names still undecided after {rounds} rounds")


def commit(tree: dict[str, DataFrame], events: DataFrame, vouched: DataFrame, findings: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tree after events(event, person_id, kind, date, place, url) that vouched(event, finding) and
    findings(finding, names, quote) stand for, and one row of counts: changed_cards, new_cards, new_evidence, new_notes.

    Events without kind or url, without a finding or without a card are left out. An evidence is added if its key is
    new, and the card is confirmed. Empty fields are filled by the first event (by number) that has them and never
    overwritten: a birth gives date, place and the parents whom the finding names, a death date and place. A parent
    who differs from the known one is a note. A parent whom no card's name stands for (equal, or words of one in the
    other) becomes a card of its own, numbered after the largest; of alike new names the first does. Marriages are
    added if their date, place and url are new. Repeated events count once; running it again changes nothing."""
    cards = tree["cards"]
    done = events.where("coalesce(kind, '') <> '' AND coalesce(url, '') <> ''").join(vouched.select("event", "finding").hint("merge"), "event").join(findings.select("finding", "names", F.col("quote").alias("said")).hint("merge"), "finding")
    done = done.join(cards.select(F.col("id").alias("person_id"), F.col("name").alias("child"), "father", "mother").hint("merge"), "person_id").withColumn("c", T.event_class("kind"))
    done = done.withColumn("quote", F.substring("said", 1, 400)).withColumn("key", T.evidence_key("kind", "date", "place", "url", "quote", F.lit("acta")))
    # the parents of the births' findings: each finding once, and each distinct text once
    births = events.where(T.event_class("kind") == "birth").select("event").join(vouched.select("event", "finding").hint("merge"), "event")
    births = written(births.select("finding").distinct(), "birth-findings")
    told = named_parents(findings.join(births.hint("merge"), "finding").select(F.col("finding").alias("id"), "names", "quote"))
    parent = lambda r, to: F.max(F.when(F.col("role") == r, F.col("name"))).alias(to)
    told = told.groupBy(F.col("id").alias("finding")).agg(parent("f", "t_father"), parent("m", "t_mother"))
    done = done.drop("names").join(told.hint("merge"), "finding", "left")
    done = written(done.withColumns({f"p_{r}": F.when(F.col("c") == "birth", F.col(f"t_{r}")) for r in ("father", "mother")}).drop("t_father", "t_mother"), "committable")
    new = done.groupBy("person_id", "key").agg(*[F.min_by(x, "event").alias(x) for x in ("kind", "date", "place", "url", "quote")])
    new = written(new.join(tree["evidence"].select("person_id", "key").hint("merge"), ["person_id", "key"], "left_anti"), "new-evidence")

    def first(value: Column | str, when: Column) -> Column:
        v = T.col(value)
        return F.min(F.when(when & (F.coalesce(v, F.lit("")) != ""), F.struct("event", v.alias("v"))))["v"]

    birth, death = F.col("c") == "birth", F.col("c") == "death"
    fills = done.groupBy("person_id").agg(
        first("date", birth).alias("f_birth_date"), first("place", birth).alias("f_birth_place"), first("date", death).alias("f_death_date"), first("place", death).alias("f_death_place"), first("p_father", birth).alias("f_father"), first("p_mother", birth).alias("f_mother"))
    wed = done.where("c = 'marriage'").select("person_id", *[F.coalesce(x, F.lit("")).alias(x) for x in ("date", "place", "url")]).distinct()
    wed = written(wed.join(tree["marriages"].hint("merge"), ["person_id", "date", "place", "url"], "left_anti"), "new-marriages")
    fields = ("birth_date", "birth_place", "death_date", "death_place", "father", "mother")
    is_new = new.groupBy("person_id").agg(F.count("*").alias("n_new"))
    is_wed = wed.groupBy("person_id").agg(F.count("*").alias("n_wed"))
    j = cards.withColumnRenamed("id", "person_id").join(fills.withColumn("met", F.lit(True)).hint("merge"), "person_id", "left").join(is_new.hint("merge"), "person_id", "left").join(is_wed.hint("merge"), "person_id", "left")
    empty = lambda f: F.coalesce(F.col(f), F.lit("")) == ""
    filled = [empty(f) & F.col(f"f_{f}").isNotNull() for f in fields]
    changed = F.col("n_new").isNotNull() | F.col("n_wed").isNotNull() | (F.col("met") & (F.col("state") != "confirmed"))
    for f in filled:
        changed = changed | f
    j = j.withColumn("changed", F.coalesce(changed, F.lit(False))).withColumn("state", F.when(F.col("met"), "confirmed").otherwise(F.col("state")))
    for f in fields:
        j = j.withColumn(f, F.when(empty(f), F.coalesce(f"f_{f}", F.lit(""))).otherwise(F.col(f)))
    j = written(j.select(F.col("person_id").alias("id"), *[c for c in cards.columns if c != "id"], "changed"), "cards")

    # who is named as a parent: the known one, or someone else
    part = lambda role: F.struct(F.lit(role).alias("role"), F.col(f"p_{role}").alias("parent"))
    named = done.where(birth).select("event", "person_id", "child", "kind", "date", "place", "url", "quote", F.explode(F.array(part("father"), part("mother"))).alias("x")).select("*", "x.*").drop("x").where("parent IS NOT NULL")
    now = j.select(F.col("id").alias("person_id"), "father", "mother")
    named = named.join(now.hint("merge"), "person_id").withColumn("known", F.when(F.col("role") == "father", F.col("father")).otherwise(F.col("mother"))).withColumn("other", F.when(F.col("role") == "father", F.col("mother")).otherwise(F.col("father"))).withColumn("k", T.norm("parent"))
    named = written(named, "named-parents")
    differs = F.col("k") != T.norm("known")
    notes = named.where(differs).groupBy("person_id", "role", "k").agg(F.min_by("parent", "event").alias("said"), F.min("known").alias("known"))
    have = tree["notes"].select("person_id", "role", T.norm("said").alias("k")).distinct()
    notes = written(notes.join(have.hint("merge"), ["person_id", "role", "k"], "left_anti").select("person_id", "role", "said", "known"), "new-notes")
    wanted = named.where(~differs).groupBy("k").agg(F.min(F.struct("event", "role", "parent", "person_id", "child", "other", "kind", "date", "place", "url", "quote")).alias("m"))
    wanted = written(wanted.select("k", F.concat(F.lpad(F.col("m.event").cast("string"), 20, "0"), "m.role", "k").alias("at"), "m.*"), "wanted")
    known = cards.select("id", T.norm("name").alias("n"))
    met = subset_pairs(wanted.select(F.col("k").alias("mine"), F.col("k").alias("w")), "mine", "w", known.select("n", F.col("n").alias("m")).distinct(), "n", "m", True).select(F.col("mine").alias("k")).distinct()
    fresh = first_of_alike(written(wanted.join(met.hint("merge"), "k", "left_anti").select("k", "at"), "unknown"))
    fresh = wanted.join(fresh.select("k").hint("merge"), "k")
    top = cards.agg(F.coalesce(F.max(F.regexp_extract("id", r"^P(\d+)$", 1).try_cast("long")), F.lit(0)).alias("top")).first().top  # one number
    fresh = written(running(fresh.withColumn("all", F.lit(0)), "all", "at", F.lit(1), "r").withColumn("id", F.concat(F.lit("P"), (F.lit(top) + F.col("r")).cast("string"))), "new-cards")
    none = F.lit("")
    stubs = fresh.select("id", F.col("parent").alias("name"), T.surname_of("parent").alias("surname"), F.when(F.col("role") == "father", "M").otherwise("F").alias("sex"), F.lit("documented").alias("state"), *[none.alias(f) for f in fields], F.col("other").alias("spouse"), F.col("child"))
    mention = fresh.select(F.col("id").alias("person_id"), T.evidence_key(F.lit("mencion_en_partida"), "date", "place", "url", "quote", F.lit("acta")).alias("key"), F.lit("mencion_en_partida").alias("kind"), "date", "place", "url", "quote")
    out = {
        "cards": j.drop("changed").unionByName(stubs.select(cards.columns)), "evidence": tree["evidence"].unionByName(new.select(tree["evidence"].columns)).unionByName(mention.select(tree["evidence"].columns)),
        "marriages": tree["marriages"].unionByName(wed.select(tree["marriages"].columns)), "notes": tree["notes"].unionByName(notes.select(tree["notes"].columns)),
    }
    count = lambda df, name: df.agg(F.count("*").alias(name))
    counts = count(j.where("changed"), "changed_cards")
    for df, name in ((stubs, "new_cards"), (new, "new_evidence"), (notes, "new_notes")):
        counts = counts.crossJoin(F.broadcast(count(df, name)))  # one row each
    return out, counts


def commit_to(spark: SparkSession, path: str, events: DataFrame, vouched: DataFrame, findings: DataFrame) -> tuple[DataFrame, str]:
    """commit() on the newest version of the tree at `path`, written as the next one: all four tables appear at once, and
    a run that is cut off leaves the version before. Returns the counts and the new folder."""
    at = current_version(spark, path)
    tree = {name: spark.createDataFrame([], ddl) for name, ddl in TREE.items()} if at is None else read_version(spark, at, TREE)
    out, counts = commit(tree, events, vouched, findings)
    counts = written(counts, "counts")
    return counts, new_version(spark, path, out)
