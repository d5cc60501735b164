"""Families from the couples that baptisms declare."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import text as T

from .tables import running, written


def couples(acts: DataFrame) -> DataFrame:
    """Baptisms with a parent: all columns and the keys fk, mk."""
    return acts.where("kind = 'bautismo' AND (father_given <> '' OR mother_given <> '')").withColumn("fk", T.person_key("father_given", "father_surname")).withColumn("mk", T.person_key("mother_given", "mother_surname"))


def families(acts: DataFrame) -> DataFrame:
    """One row per declared couple: first act, its place, children by year (unknown first), span of years."""
    kids = F.array_sort(F.collect_list(F.struct(F.coalesce("year", F.lit(-1)).alias("y"), "id", "given")))
    return (couples(acts).groupBy("fk", "mk").agg(F.min("id").alias("first_id"), F.min_by("parish", "id").alias("parish"), F.min_by("municipality", "id").alias("municipality"), F.count("*").alias("children"), F.min("year").alias("year_lo"), F.max("year").alias("year_hi"), kids.alias("k"))
            .withColumn("names", F.array_join(F.transform("k", lambda x: x["given"]), ",")).drop("k"))


def without_marriage(fams: DataFrame, acts: DataFrame) -> DataFrame:
    """Families of two parents of whom no act says that they married, in either order."""
    married = acts.where("kind = 'matrimonio'").select(T.person_key("given", "surname1").alias("a"), T.person_key("spouse_given", "spouse_surname").alias("b")).select(T.pair_key("a", "b").alias("couple"))
    return fams.where("fk <> '' AND mk <> ''").withColumn("couple", T.pair_key("fk", "mk")).join(married.hint("merge"), "couple", "left_anti").drop("couple")


def without_baptism(fams: DataFrame, acts: DataFrame) -> DataFrame:
    """Keys (name::municipality) of parents who are the subject of no baptism of the place of their family."""
    place = F.concat(F.lit("::"), T.norm("municipality"))
    parents = fams.select(F.explode(F.array("fk", "mk")).alias("p"), place.alias("at")).where("p <> ''").select(F.concat("p", "at").alias("k")).distinct()
    return parents.join(acts.where("kind = 'bautismo'").select(F.concat(T.person_key("given", "surname1"), place).alias("k")).hint("merge"), "k", "left_anti")


def provisional_people(acts: DataFrame) -> DataFrame:
    """The people of the families that baptisms declare: number, id, k, year, label, surname1, surname2, municipality,
    father_id, mother_id, children, mentions.

    Families are ordered by first year (unknown last) and the parents' names; a family mentions its father, its mother
    and its children by year (unknown first), then id. Mentions of one name and surname are one person for each year;
    those without a year join the earliest dated one, or are one person if none is. The name is the one of most words,
    other fields are the first that are not empty, all by the order of mentions; people are numbered by their first
    mention. A name that several people have is labelled with the year, and from the second of a year on with its
    place among them. Parents without a name, and children without one, are nobody; no baptism, no rows."""
    c = couples(acts)
    text = lambda g, *s: F.trim(F.regexp_replace(F.concat_ws(" ", g, *s), " +", " "))
    full = {r: F.when(F.coalesce(f"{r}_given", F.lit("")) != "", text(f"{r}_given", f"{r}_surname", f"{r}_surname2")).otherwise("") for r in ("father", "mother")}
    head = c.groupBy("fk", "mk").agg(F.min("year").alias("lo"), F.min(F.struct("id", *[F.coalesce(x, F.lit("")).alias(x) for x in ("father_given", "father_surname", "father_surname2", "mother_given", "mother_surname", "mother_surname2", "municipality")])).alias("m"))
    head = written(head.select("fk", "mk", F.coalesce("lo", F.lit(9999)).alias("lo"), "m.*").withColumns({"father": full["father"], "mother": full["mother"]}), "families")
    at = lambda slot, year, i: F.struct("lo", "father", "mother", "fk", "mk", F.lit(slot).alias("slot"), year.alias("cy"), i.alias("ci")).alias("at")
    none, zero = F.lit(None).cast("int"), F.lit(0).cast("long")
    parent = lambda r, slot: head.where(F.col(f"{r}_given") != "").select(F.col("fk" if r == "father" else "mk").alias("k"), none.alias("y"), F.col(r).alias("name"), F.col(f"{r}_surname").alias("s1"), F.col(f"{r}_surname2").alias("s2"), "municipality", F.lit("").alias("up_f"), F.lit("").alias("up_m"), at(slot, F.lit(-1), zero))
    kid = c.where("given <> ''").select("fk", "mk", "id", "year", T.person_key("given", "surname1").alias("k"), text("given", "surname1", "surname2").alias("name"), F.coalesce("surname1", F.lit("")).alias("s1"), F.coalesce("surname2", F.lit("")).alias("s2"))
    kid = kid.join(head.select("fk", "mk", "lo", "father", "mother", "municipality", "father_given", "mother_given").hint("merge"), ["fk", "mk"])
    up = lambda r, k: F.when(F.col(f"{r}_given") != "", F.col(k)).otherwise("")
    kid = kid.select("k", F.col("year").alias("y"), "name", "s1", "s2", "municipality", up("father", "fk").alias("up_f"), up("mother", "mk").alias("up_m"), at(2, F.coalesce("year", F.lit(-1)), F.col("id")))
    m = written(parent("father", 0).unionByName(parent("mother", 1)).unionByName(kid), "mentions")
    first = m.groupBy("k").agg(F.min("y").alias("year0"))
    m = m.join(first.hint("merge"), "k").withColumn("year", F.coalesce("y", "year0"))
    some = lambda x: F.min(F.when(F.col(x) != "", F.struct("at", x)))[x]
    who = m.groupBy("k", "year").agg(
        F.min("at").alias("at"), F.min_by("name", F.struct((-F.size(F.split("name", " "))).alias("w"), "at")).alias("name"), *[F.coalesce(some(x), F.lit("")).alias(to) for x, to in (("s1", "surname1"), ("s2", "surname2"), ("municipality", "municipality"), ("up_f", "up_f"), ("up_m", "up_m"))],
        F.count("*").alias("mentions"))
    who = written(running(who.withColumn("all", F.lit(0)), "all", "at", F.lit(1), "number"), "people")
    who = who.drop("all").withColumn("id", F.concat(F.lit("AV"), F.when(F.col("number") < 1000, F.lpad(F.col("number").cast("string"), 3, "0")).otherwise(F.col("number").cast("string"))))
    # a parent is the person whom mentions without a year are
    known = who.join(first.hint("merge"), "k").where(F.col("year").eqNullSafe(F.col("year0"))).select("k", F.col("id").alias("pid"))
    kids = m.where("up_f <> '' OR up_m <> ''").select("k", "year", F.explode(F.array_distinct(F.array("up_f", "up_m"))).alias("up")).where("up <> ''").distinct().groupBy("up").agg(F.count("*").alias("children"))
    mine = known.join(kids.withColumnRenamed("up", "k").hint("merge"), "k").select(F.col("pid").alias("id"), "children")
    names, years = Window.partitionBy("name"), Window.partitionBy("name", "year").orderBy("number")
    who = who.withColumn("n", F.count("*").over(names)).withColumn("r", F.row_number().over(years))
    year = F.concat(F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("¿?")), F.when(F.col("r") > 1, F.concat(F.lit(" #"), F.col("r"))).otherwise(""), F.lit(")"))
    who = who.withColumn("label", F.concat("name", F.when(F.col("n") > 1, year).otherwise("")))
    for k, to in (("up_f", "father_id"), ("up_m", "mother_id")):
        who = who.join(known.select(F.col("k").alias(k), F.col("pid").alias(to)).hint("merge"), k, "left")
    return who.join(mine.hint("merge"), "id", "left").select("number", "id", "k", "year", "label", "surname1", "surname2", "municipality", "father_id", "mother_id", F.coalesce("children", F.lit(0)).alias("children"), "mentions")
