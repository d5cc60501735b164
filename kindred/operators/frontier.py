"""What to look for next: searches over cards and candidates, against a table of those already made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import text as T

from .matching import first_by, resolve
from .tables import written

#: Points for archives that can be read from afar, by province, and for what a search is about.
SIBLING_BONUS, CANDIDATE, HINT, HIGHEST = 0.5, 5.0, 2.0, 10.0


def digitised(province: Column | str, points: dict[str, int]) -> Column:
    out = F.lit(0)
    for p, n in points.items():
        out = F.when(T.col(province) == p, n).otherwise(out)
    return out


def searches(cards: DataFrame, points: dict[str, int]) -> DataFrame:
    """key, kind, anchor, id, priority: one search a card of cards(id, seq, name, surname, province, birth_year, father, mother, sure).

    A sure card whose named parents are not all sure (each name resolved to a sure card, see matching.resolve) asks for
    its `parents`; one whose parents are, for its `siblings`, once a couple, by the card with the smallest seq; one
    without parents asks for nothing; a card that is not sure asks for the `person`. The priority is 1.5 times the
    surname's rarity, the province's points, 2 for a sure card or 1 for a known year, 1 for a year up to 1900, and
    SIBLING_BONUS, at most HIGHEST. Cards without a name are left out. Couples are told by normalised names in either order."""
    c = written(cards.where(T.norm("name") != ""), "cards")
    up = c.select("id", F.explode(F.array_distinct(F.filter(F.transform(F.array("father", "mother"), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""))).alias("name"))
    names = up.select("name").distinct().select(F.col("name").alias("qid"), "name", F.lit(None).cast("int").alias("year"))
    found = resolve(names, c.select("id", "name", "birth_year")).where("person_id IS NOT NULL").select(F.col("qid").alias("name"), "person_id")
    sure = found.join(c.where("sure").select(F.col("id").alias("person_id")).hint("merge"), "person_id").select("name", F.lit(True).alias("known"))
    parents = up.join(sure.hint("merge"), "name", "left").groupBy("id").agg(F.count_if(F.col("known").isNull()).alias("open"), F.array_join(F.array_sort(F.collect_list(T.norm("name"))), "::").alias("couple"))
    j = c.join(parents.hint("merge"), "id", "left")
    kind = F.when(~F.col("sure"), "person").when(F.col("couple").isNull(), None).when(F.col("open") > 0, "parents").otherwise("siblings")
    j = written(j.withColumn("kind", kind).where("kind IS NOT NULL"), "kinds")
    once = first_by(j.where("kind = 'siblings'"), ["couple"], "seq")
    every = j.where("kind <> 'siblings'").unionByName(once)
    year = F.col("birth_year")
    score = T.rarity("surname") * 1.5 + digitised("province", points) + F.when(F.col("sure"), 2).when(year.isNotNull(), 1).otherwise(0) + F.when(year <= 1900, 1).otherwise(0) + F.when(F.col("kind") == "siblings", SIBLING_BONUS).otherwise(0)
    key = F.concat(F.col("kind"), F.lit("::"), F.when(F.col("kind") == "siblings", F.col("couple")).otherwise(T.norm("name")))
    return every.select(key.alias("key"), "kind", T.norm("name").alias("anchor"), "id", F.least(F.lit(HIGHEST), score).alias("priority"))


def frontier(own: DataFrame, candidates: DataFrame, prints: DataFrame, made: DataFrame) -> DataFrame:
    """key, kind, anchor, id, priority, status of searches own (see searches()), then candidates(name, surname, hint), against
    made(key, print), the searches that were made and the fingerprint that the anchor's evidence had.

    `queued`: not made yet; `reopened`: made, but prints(anchor, print) differs now and both are not empty; `omitted`: made and
    nothing new; `gone`: made, and no longer asked for (anchor and id null). A candidate is a search of its own unless
    one of the queue has its name already (omitted ones do not count); a name proposed as candidate and as hint is a
    candidate. Repeated keys of `made` count with their largest print; repeated candidates are one."""
    done = made.groupBy("key").agg(F.max(F.coalesce("print", F.lit(""))).alias("old"))
    now = prints.select("anchor", F.coalesce("print", F.lit("")).alias("now"))
    known = F.col("old").isNotNull()
    news = (F.coalesce("old", F.lit("")) != "") & (F.coalesce("now", F.lit("")) != "") & (F.col("old") != F.col("now"))
    status = F.when(~known, "queued").when(news, "reopened").otherwise("omitted")
    columns = ["key", "kind", "anchor", "id", "priority", "status"]

    def judged(df: DataFrame) -> DataFrame:
        j = df.join(now.hint("merge"), "anchor", "left").join(done.hint("merge"), "key", "left")
        return j.withColumn("status", status).select(columns)

    first = written(judged(own), "own")
    taken = first.where("status <> 'omitted'").select("anchor").distinct()
    c = candidates.select(T.norm("name").alias("anchor"), "surname", "hint").where("anchor <> ''").groupBy("anchor").agg(F.min("hint").alias("hint"), F.min_by("surname", F.struct("hint", "surname")).alias("surname"))
    c = c.join(taken.hint("merge"), "anchor", "left_anti")
    c = c.select(F.concat(F.lit("candidate::"), "anchor").alias("key"), F.lit("candidate").alias("kind"), "anchor", F.lit(None).cast("string").alias("id"), (T.rarity("surname") * 1.5 + F.when(F.col("hint"), HINT).otherwise(CANDIDATE)).alias("priority"))
    second = written(judged(c), "candidates")
    both = first.unionByName(second)
    none = lambda kind: F.lit(None).cast(kind)
    gone = done.join(both.select("key").distinct().hint("merge"), "key", "left_anti").select("key", F.split("key", "::")[0].alias("kind"), none("string").alias("anchor"), none("string").alias("id"), none("double").alias("priority"), F.lit("gone").alias("status"))
    return both.unionByName(gone)
