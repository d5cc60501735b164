"""The tree as five tables of a family graph whose references agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import text as T

from .tables import running, side, written


def _numbered(df: DataFrame, order: list[str], prefix: str) -> DataFrame:
    """df with ref: prefix and a dense number by the order, given over ranges."""
    at = df.withColumn("at", F.struct(*order)).withColumn("all", F.lit(0))
    return running(at, "all", "at", F.lit(1), "n").withColumn("ref", F.concat(F.lit(prefix), F.col("n").cast("string"))).drop("at", "all", "n")


def graph_edges(edges: DataFrame) -> DataFrame:
    """edges(card, role, other, name, placeholder) once each, without those who are their own spouse; written."""
    return written(edges.where("card <> other OR role <> 's'").groupBy("card", "role").agg(F.min("other").alias("other"), F.min_by("name", F.struct("other", "name")).alias("name"), F.min_by("placeholder", "other").alias("placeholder")), "edges")


def graph_persons(people: DataFrame, e: DataFrame) -> DataFrame:
    """ref, id, name, born, place, named_only: the cards by seq, then those whom graph_edges() e only name, by key; written."""
    cards = people.select("id", "seq", "name", T.graph_date("birth_date").alias("born"), "place", F.lit(False).alias("named_only"))
    named = e.where("placeholder").groupBy(F.col("other").alias("id")).agg(F.min("name").alias("name"))
    named = named.select("id", F.lit(None).cast("long").alias("seq"), "name", F.lit("").alias("born"), F.lit("").alias("place"), F.lit(True).alias("named_only"))
    return written(_numbered(cards.unionByName(named), ["named_only", "seq", "id"], "I"), "persons").select("ref", "id", "name", "born", "place", "named_only")


def graph_families(people: DataFrame, e: DataFrame, ref: DataFrame) -> tuple[DataFrame, DataFrame]:
    """families and links of graph_edges() e, whose people have ref(id, ref)."""
    role = lambda r: F.max(F.when(F.col("role") == r, F.col("other")))
    both = written(e.where("role <> 's'").groupBy("card").agg(role("f").alias("husband"), role("m").alias("wife")).join(people.select(F.col("id").alias("card"), "seq").hint("merge"), "card"), "couples")
    parents = both.groupBy("husband", "wife").agg(F.min("seq").alias("first")).withColumn("childless", F.lit(False))
    pair = lambda a, b: T.pair_key(a, b)
    known = parents.where("husband IS NOT NULL AND wife IS NOT NULL").select(pair("husband", "wife").alias("pair")).distinct()
    wed = e.where("role = 's'").join(people.select(F.col("id").alias("card"), "seq").hint("merge"), "card").withColumn("pair", pair("card", "other")).join(known.hint("merge"), "pair", "left_anti")
    wed = wed.groupBy("pair").agg(F.min(F.struct("seq", "card", "other")).alias("m")).select(F.col("m.card").alias("husband"), F.col("m.other").alias("wife"), F.col("m.seq").alias("first"), F.lit(True).alias("childless"))
    families = written(_numbered(parents.unionByName(wed), ["childless", "first", "husband", "wife"], "F"), "families")

    spouse = families.select(F.col("ref").alias("family"), F.explode(F.array(F.struct(F.lit("husband").alias("role"), F.col("husband").alias("id")), F.struct(F.lit("wife").alias("role"), F.col("wife").alias("id")))).alias("x")).select("family", "x.*").where("id IS NOT NULL")
    same = [F.col("c.husband").eqNullSafe(F.col("f.husband")), F.col("c.wife").eqNullSafe(F.col("f.wife"))]
    child = both.alias("c").join(families.where("NOT childless").alias("f").hint("merge"), same).select(F.col("f.ref").alias("family"), F.lit("child").alias("role"), F.col("c.card").alias("id"))
    links = spouse.unionByName(child).join(ref.withColumnRenamed("ref", "person").hint("merge"), "id").select("family", "role", "person")
    named_by = lambda c: ref.select(F.col("id").alias(c), F.col("ref").alias(f"{c}_ref")).hint("merge")
    families = families.join(named_by("husband"), "husband", "left").join(named_by("wife"), "wife", "left").select("ref", F.col("husband_ref").alias("husband"), F.col("wife_ref").alias("wife"), "childless")
    return families, links


def graph_sources(findings: DataFrame) -> DataFrame:
    """ref, url, first_use, uses of findings(id, url); written."""
    return written(_numbered(findings.where("url <> ''").groupBy("url").agg(F.min("id").alias("first_use"), F.count("*").alias("uses")), ["first_use", "url"], "S"), "sources").select("ref", "url", "first_use", "uses")


def graph_notes(findings: DataFrame, ref: DataFrame, sources: DataFrame) -> DataFrame:
    """finding, person, source, kind, date of findings(id, person_id, url, kind, fecha) of known people."""
    notes = findings.where("person_id IS NOT NULL").join(ref.select(F.col("id").alias("person_id"), F.col("ref").alias("person")).hint("merge"), "person_id").join(side(sources.select("url", F.col("ref").alias("source")), "source-refs"), "url", "left")
    return notes.select(F.col("id").alias("finding"), "person", "source", T.event_class("kind").alias("kind"), T.graph_date("fecha").alias("date"))


def graph_tables(people: DataFrame, edges: DataFrame, findings: DataFrame) -> dict[str, DataFrame]:
    """persons, families, links, sources, notes of people(id, seq, name, birth_date, place), edges(card, role, other, name,
    placeholder) to fathers (f), mothers (m) and spouses (s), and findings(id, person_id, url, kind, fecha).

    persons: the cards by seq, then those who are only named, by key; families: the couples of the children's parents
    by their first child (one of the two may be missing), then other couples by their first card; links: who is husband,
    wife and child of which family; sources: one a url, by first use; notes: findings of known people. Each table names
    others by ref, and every ref is a row of its table. Findings without a person are no notes but use their source;
    those without url name none. Nobody is their own spouse. Repeated edges are one. Each table alone: the functions above."""
    e = graph_edges(edges)
    persons, sources = graph_persons(people, e), graph_sources(findings)
    ref = persons.select("id", "ref")
    families, links = graph_families(people, e, ref)
    return {"persons": persons, "families": families, "links": links, "sources": sources, "notes": graph_notes(findings, ref, sources)}
