"""Looking places up in a gazetteer, by the beginning of their names and other names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import text as T

from .tables import written

#: Letters of a name's beginning that the index holds.
PREFIX = 4


def other_names(aliases: DataFrame, rounds: int = 30) -> DataFrame:
    """(k, other) of aliases(k, other): all names that are reached over aliases in either direction, without the name
    itself. A round follows one more step from what the last one found; more than `rounds` raise."""
    a = aliases.select(T.norm("k").alias("k"), T.norm("other").alias("other")).where("k <> '' AND other <> '' AND k <> other")
    step = written(a.union(a.select("other", "k")).distinct(), "aliases")
    out = new = step
    for _ in range(rounds):
        new = new.join(step.select(F.col("k").alias("other"), F.col("other").alias("next")).hint("merge"), "other").select("k", F.col("next").alias("other")).where("k <> other").distinct()
        new = written(new.join(out.hint("merge"), ["k", "other"], "left_anti"), "aliases")
        if new.isEmpty():
            return out
        out = out.unionByName(new)
    raise RuntimeError(f"aliases still found after {rounds} rounds")


def lookup(places: DataFrame, aliases: DataFrame, gazetteer: DataFrame, outages: DataFrame) -> DataFrame:
    """place, province, status, form, n, first of the distinct places(place, province).

    A place is asked for by its name, its name's first word, then its other names in order, each followed by its first
    word; a form finds the localities of gazetteer(loc_id, name, province) whose names begin with it, of the province
    (within the locality's, if one is asked for). outages(form, province) did not answer, and a null form is all forms
    of the province. `found`: the first form that finds any, with their number and smallest loc_id; `not_found`: a
    form answered and none finds any; `unavailable`: none answered, which says nothing about the place. Case, accents
    and spaces do not matter; a place without a name is `not_found` unless its province is out.

    The index is keyed by the first letters, up to PREFIX; a form looks up its own first letters and is compared whole."""
    p = written(places.select("place", "province").distinct().withColumn("k", T.norm("place")).withColumn("prov", T.norm("province")), "places")
    others = other_names(aliases).groupBy("k").agg(F.array_sort(F.collect_set("other")).alias("others"))
    names = p.select("k").distinct().join(others.hint("merge"), "k", "left")
    each = F.concat(F.array("k"), F.coalesce("others", F.array().cast("array<string>")))
    forms = F.array_distinct(F.flatten(F.transform(each, lambda x: F.array(x, F.get(F.split(x, " "), 0)))))
    forms = written(names.select("k", F.posexplode(F.filter(forms, lambda x: x != "")).alias("pos", "form")), "forms")
    asked = p.select("k", "prov").distinct().join(forms.hint("merge"), "k")
    out = outages.select(F.when(F.col("form").isNotNull(), T.norm("form")).alias("form"), T.norm("province").alias("prov")).distinct()
    whole = out.where("form IS NULL").select("prov", F.lit(True).alias("whole"))
    single = out.where("form IS NOT NULL").select("prov", "form", F.lit(True).alias("single"))
    asked = written(asked.join(whole.hint("merge"), "prov", "left").join(single.hint("merge"), ["prov", "form"], "left").withColumn("down", F.col("whole").isNotNull() | F.col("single").isNotNull()), "asked")
    # a name of a province once, whatever localities have it
    g = gazetteer.select("loc_id", T.norm("name").alias("name"), T.norm("province").alias("of")).where("name <> ''").groupBy("name", "of").agg(F.count("*").alias("n"), F.min("loc_id").alias("first"))
    index = written(g.withColumn("piece", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(PREFIX)), lambda j: F.substring("name", F.lit(1), j))))), "index")
    query = asked.where("NOT down").select("form", "prov").distinct().withColumn("piece", F.substring("form", 1, PREFIX))
    hits = query.join(index.hint("merge"), "piece").where(F.startswith(F.col("name"), F.col("form")) & ((F.col("prov") == "") | F.contains(F.col("of"), F.col("prov"))))
    hits = written(hits.groupBy("form", "prov").agg(F.sum("n").alias("n"), F.min("first").alias("first")), "hits")
    answer = asked.join(hits.hint("merge"), ["form", "prov"], "left").groupBy("k", "prov").agg(F.min(F.when(F.col("n").isNotNull(), F.struct("pos", "form", "n", "first"))).alias("m"), F.bool_and("down").alias("silent"))
    silent = F.coalesce("silent", F.col("whole").isNotNull())
    j = p.join(answer.hint("merge"), ["k", "prov"], "left").join(whole.hint("merge"), "prov", "left")
    return j.select("place", "province", F.when(F.col("m").isNotNull(), "found").when(silent, "unavailable").otherwise("not_found").alias("status"), F.col("m.form").alias("form"), F.coalesce("m.n", F.lit(0)).alias("n"), F.col("m.first").alias("first"))
