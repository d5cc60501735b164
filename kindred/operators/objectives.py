"""What to ask search engines about a person: queries by template, objectives with equal sets of them only once."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import text as T

# The queries of each kind; a query is made if all of its fields are there (needs: further ones, and what
# must not be there with !). For each municipality:
PLACE_QUERIES = [
    # nominal
    ('"{name}" "{mun}"', ""), ('"{form}" "{mun}"', ""),
    # kin and siblings
    ('"{father}" "{mun}"', ""), ('"{mother}" "{mun}"', ""), ('"{father}" "{mother}" "{mun}"', ""), ('"{father}" "{mother}" "matrimonio"', ""), ('"hijos de {father} y {mother}"', ""), ('"hijo de {father} y {mother}" "{mun}"', ""),
    ('"{father}" "{mother}" "expediente matrimonial"', ""), ('"bautismo hijo de {father} y {mother}"', "sure"), ('"bautismo hijo de {father} y {mother}" "{mun}"', "sure"), ('"bautismo hijo de {father}" "{mun}"', "sure"),
    ('"bautismo hijo de {mother}" "{mun}"', "sure"), ('"hijo de {father} y {mother}" "{mun}" "bautismo"', "sure"), ('"hijo de {father}" "{mun}"', ""), ('"hijo de {mother}" "{mun}"', ""),
    # censuses and cadastre
    ('"{mun}" "padrón"', ""), ('"{mun}" "padrones" "archivo"', ""), ('"{mun}" "amillaramiento"', ""), ('"{mun}" "quintas" "sorteo"', ""), ('"{mun}" "censo electoral"', ""), ('"{mun}" "Catastro de Ensenada"', "!exempt"), ('"{surname1}" "Catastro de Ensenada" "{mun}"', "!exempt"),
    # parish and diocese
    ('"{mun}" "Archivo Diocesano"', ""), ('"{mun}" "libros sacramentales"', ""), ('"{mun}" "partidas sacramentales"', ""), ('"{mun}" "bautismos"', ""), ('"{mun}" "matrimonios"', ""), ('"{mun}" "defunciones"', ""), ('"{mun}" "Archivo Diocesano de {prov}"', ""),
]
# For each province, for a person without any place, and for all.
PROVINCE_QUERIES, NOWHERE_QUERIES, PERSON_QUERIES = ['"{name}" "{prov}"'], ['"{name}"'], ['"{name}" "{spouse}"']


def fill(template: str, fields: dict[str, Column]) -> Column:
    """The template with its fields, null if one is empty."""
    parts = [p for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(*[F.nullif(fields[p[1:-1]], F.lit("")) if p.startswith("{") else F.lit(p) for p in parts])


def queries_of(card: dict[str, Column], muns: Column, provs: Column, forms: Column, sure: Column, exempt: Column) -> Column:
    """All queries of a person, distinct and in the order of their bytes."""
    flag = {"": F.lit(True), "sure": sure, "!exempt": ~exempt}

    def at(mun: Column) -> Column:
        out = []
        for template, needs in PLACE_QUERIES:
            make = lambda more, t=template, n=needs: F.when(flag[n], fill(t, {**card, "mun": mun, **more}))
            if "{form}" in template:
                out.append(F.transform(forms, lambda f: make({"form": f})))
            elif "{prov}" in template:
                out.append(F.transform(provs, lambda p: make({"prov": p})))
            else:
                out.append(F.array(make({})))
        return F.concat(*out)

    each = F.concat(
        F.flatten(F.transform(muns, at)), F.flatten(F.transform(provs, lambda p: F.array(*[fill(t, {**card, "prov": p}) for t in PROVINCE_QUERIES]))),
        F.array(*[F.when((F.size(muns) == 0) & (F.size(provs) == 0), fill(t, card)) for t in NOWHERE_QUERIES], *[fill(t, card) for t in PERSON_QUERIES]))
    return F.array_sort(F.array_distinct(F.array_compact(each)))


def objectives(cards: DataFrame, exempt: list[str]) -> DataFrame:
    """seq, name, municipality, province, queries, fingerprint of cards(seq, name, surname1, surname2, father, mother, spouse,
    municipalities, provinces, sure), without those whose set of queries an earlier card (by seq) has.

    Surnames are asked for in all their spellings, the second one's unless it is a form of the first. A person in a
    province of `exempt` has no cadastre; `sure` says that both parents are confirmed, which asks for the siblings.
    Cards without a name are left out; empty and null places are none. Sets are told apart by a SHA-256 of their sorted
    queries: only that and the smallest seq of each are shuffled twice, never the sets of all cards into one place."""
    clean = lambda c: F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != "")))
    c = cards.where(F.trim(F.coalesce("name", F.lit(""))) != "").withColumns({"municipalities": clean(F.col("municipalities")), "provinces": clean(F.col("provinces"))})
    second = F.filter(T.spelling_forms("surname2"), lambda f: T.norm(f) != T.norm("surname1"))
    card = {x: F.trim(F.coalesce(x, F.lit(""))) for x in ("name", "surname1", "father", "mother", "spouse")}
    out = F.exists("provinces", lambda p: T.norm(p).isin([x.lower() for x in exempt])) if exempt else F.lit(False)
    asked = queries_of(card, F.col("municipalities"), F.col("provinces"), F.concat(T.spelling_forms("surname1"), second), F.coalesce("sure", F.lit(False)), out)
    made = c.select("seq", F.trim("name").alias("name"), F.coalesce(F.get("municipalities", 0), F.lit("")).alias("municipality"), F.coalesce(F.get("provinces", 0), F.lit("")).alias("province"), asked.alias("queries"))
    made = made.withColumn("fingerprint", F.sha2(F.array_join("queries", "\n"), 256))
    first = made.groupBy("fingerprint").agg(F.min("seq").alias("seq"))
    return made.join(first.hint("merge"), ["fingerprint", "seq"], "left_semi").select("seq", "name", "municipality", "province", "queries", "fingerprint")
