"""Evidence: audits, plausibility, levels, scores and seals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import text as T

from .matching import decided, first_by, in_window, resolve
from .tables import side, written


def audit_citations(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """quotes(id, url, quote) against texts(url, original, clean): empty, no_text, original, fallback or review.
    The first 400 normalised characters of the quotation must be in the original text or, without one, in
    the cleaned one. A join on the url; texts are normalised once."""
    q = quotes.withColumn("k", T.norm("quote"))
    x = texts.select("url", T.norm(F.coalesce("original", "clean")).alias("body"), F.col("original").isNotNull().alias("is_original"), F.lit(True).alias("met"))
    hit = F.contains("body", F.trim(F.substring("k", 1, 400)))
    status = F.when(F.col("k") == "", "empty").when(F.col("met").isNull(), "no_text").when(hit & F.col("is_original"), "original").when(hit, "fallback").otherwise("review")
    return q.join(x.hint("merge"), "url", "left").withColumn("status", status).groupBy("id").agg(F.min_by("status", F.array_position(F.array(*[F.lit(s) for s in ("original", "fallback", "empty", "no_text", "review")]), F.col("status"))).alias("status"))


def plausibility(findings: DataFrame, people: DataFrame, resolved: DataFrame) -> DataFrame:
    """id, status of birth findings whose person is known: the event's year against every year known of each
    parent. Dates that were derived have wider limits; missing data never flags."""
    birth = T.event_class("kind") == "birth"
    derived = (F.col("precision") == "aproximada") & F.col("reason").rlike("->|nacimiento estimado|edad |cálculo|calculado")
    b = findings.where(birth).join(resolved.where("person_id IS NOT NULL").select(F.col("qid").alias("id"), "person_id").hint("merge"), "id").select("id", "person_id", T.year_of("fecha").alias("y"), derived.alias("derived"))
    years = people.where("birth_year IS NOT NULL").select(F.col("id").alias("parent"), F.col("birth_year").alias("py")).union(b.where("y IS NOT NULL").select("person_id", "y")).distinct()
    named = people.select("id", F.explode(F.array(F.struct(F.lit("f").alias("role"), F.col("father").alias("name")), F.struct(F.lit("m").alias("role"), F.col("mother").alias("name")))).alias("x")).select("id", "x.*").where("name <> ''")
    who = resolve(named.select(F.concat_ws(":", "id", "role").alias("qid"), "name", F.lit(None).cast("int").alias("year")), people).where("person_id IS NOT NULL")
    parents = who.select(F.split_part("qid", F.lit(":"), F.lit(1)).alias("person_id"), F.split_part("qid", F.lit(":"), F.lit(2)).alias("role"), F.col("person_id").alias("parent"))
    d = F.col("y") - F.col("py")
    flag = ((d < F.when(F.col("derived"), 8).otherwise(13)) & ~(F.col("derived") & (d >= 0))) | ((F.col("role") == "m") & F.when(F.col("derived"), d > 70).otherwise(d > 55)) | ((F.col("role") == "f") & F.col("derived") & (d > 80))
    told = b.join(parents.hint("merge"), "person_id").join(years.hint("merge"), "parent").groupBy("id").agg(F.count(d).alias("n"), F.bool_or(flag).alias("flag"))
    status = F.when(F.col("y").isNull() | (F.coalesce("n", F.lit(0)) == 0), "NO_COMPROBABLE").when(F.col("flag"), "DUDOSO").when(F.col("derived"), "OK_DERIVADO").otherwise("OK")
    return b.join(told.hint("merge"), "id", "left").select("id", status.alias("status"))


def with_tokens(df: DataFrame, card: dict[str, str]) -> DataFrame:
    """df(person, names) with the token lists that relative_named() compares, each made once."""
    others = F.array_join(F.coalesce("names", F.array().cast("array<string>")), " ")
    return df.withColumns({"own_t": T.name_tokens("person"), "others_t": T.name_tokens(others), **{f"{r}_t": T.name_tokens(c) for r, c in card.items()}})


def relative_named(roles: list[str]) -> Column:
    """The first role whose known name has all its tokens among the other names of the document and not just among
    the person's own, in a table of with_tokens(); null if none."""
    told = lambda r: (F.size(f"{r}_t") > 0) & T.subset(F.col(f"{r}_t"), F.col("others_t")) & ~T.subset(F.col(f"{r}_t"), F.col("own_t"))
    return F.coalesce(*[F.when(told(r), r) for r in roles])


def named_parents(findings: DataFrame) -> DataFrame:
    """id, role (f, m), name: the one parent that each of findings(id, names, quote) names for a role, as
    functions.text.parent_of says. What a text says is found once for each distinct text, then joined back; written."""
    n = F.coalesce("names", F.array().cast("array<string>"))
    texts = findings.select("id", F.size(n).alias("n"), F.posexplode(F.concat(n, F.array("quote"))).alias("pos", "x"))
    texts = written(texts.where(F.contains("x", F.lit("(")) | F.col("x").rlike("(?i)hij")).select("id", (F.col("pos") == F.col("n")).alias("quoted"), "pos", "x"), "parent-texts")
    distinct = written(texts.select("x").distinct(), "parent-texts-distinct")
    told = side(distinct.select("x", F.explode(T.parents_told("x")).alias("c")).select("x", "c.*", T.norm("c.name").alias("k")), "parents-told")
    each = texts.join(told, "x").where("NOT quoted OR phrase = 1")
    at = F.struct("phrase", "pos", "at", "name")
    own, quoted = ~F.col("quoted"), F.col("quoted")
    g = each.groupBy("id", "role").agg(*[f(F.when(w, c)).alias(f"{p}_{to}") for p, w in (("n", own), ("q", quoted)) for f, c, to in ((F.min, F.col("k"), "lo"), (F.max, F.col("k"), "hi"), (F.min, at, "first"))])
    name = F.when(F.col("n_lo").isNull(), F.when(F.col("q_lo") == F.col("q_hi"), F.col("q_first.name"))).when(F.col("n_lo") == F.col("n_hi"), F.col("n_first.name"))
    return written(g.select("id", F.when(F.col("role") == "padre", "f").otherwise("m").alias("role"), name.alias("name")).where("name IS NOT NULL"), "named-parents")


def confirmed_parents(findings: DataFrame, people: DataFrame) -> DataFrame:
    """id, father, mother, father_year, mother_year of birth and marriage findings that name one father and one
    mother, both known for sure, with evidence and of different names. Both roles are resolved at once, each distinct
    name once."""
    asked = named_parents(findings.where(T.event_class("kind").isin("birth", "marriage")))
    names = written(asked.select("name").distinct(), "parent-names")
    who = resolve(names.select(F.col("name").alias("qid"), "name", F.lit(None).cast("int").alias("year")), people).where("person_id IS NOT NULL").select(F.col("qid").alias("name"), "person_id")
    cards = people.where("n_evidence > 0").select(F.col("id").alias("person_id"), T.norm("name").alias("k"), "birth_year")
    each = asked.join(side(who.join(cards.hint("merge"), "person_id"), "known-parents"), "name")
    of = lambda r, c: F.max(F.when(F.col("role") == r, F.col(c)))
    both = each.groupBy("id").agg(of("f", "person_id").alias("father"), of("m", "person_id").alias("mother"), of("f", "birth_year").alias("father_year"), of("m", "birth_year").alias("mother_year"), of("f", "k").alias("fk"), of("m", "k").alias("mk"))
    return both.where("father IS NOT NULL AND mother IS NOT NULL AND fk <> mk").select("id", "father", "mother", "father_year", "mother_year")


def places_met(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """(a, b): the distinct places of either side of which one contains the other, normalised. The shorter one's
    first four characters are a piece of the longer one, so the join is on equality."""
    # written, so that only distinct places are normalised
    x = written(left.select(a).distinct(), "places").select(a, T.norm(a).alias("x")).where("x <> ''")
    y = written(right.select(b).distinct(), "homes").select(b, T.norm(b).alias("y")).where("y <> ''")
    pieces = lambda c: F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.length(c) - i + 1)), lambda n: F.substring(c, i, n)))))).alias("g")
    one = lambda p, c, q, d: p.select("*", F.substring(c, 1, 4).alias("g")).join(q.select("*", pieces(d)).hint("merge"), "g").where(F.contains(d, F.col(c))).select(a, b)
    return one(x, "x", y, "y").union(one(y, "y", x, "x")).distinct()


#: Years around the family's own in which a new person is coherent, and those without any.
GENERATION_WINDOW, ANY_YEAR = 90, (1700, 2100)


def classify(findings: DataFrame, people: DataFrame) -> DataFrame:
    """id, person, person_id, level, facts, father, mother (the two confirmed parents, if any) of every finding.

    A known person gives the fact `name`; a coherent date, a shared place and a named relative are further
    facts. A contradiction or a namesake is weak, two facts confirm, one is strong. An unknown person is
    confirmed by two confirmed parents whose years allow the event; else two surname words of the family,
    a place of it and a coherent year make it strong, and the rest is weak. What depends on a name and year or on a place
    alone is found once for each and joined to the findings by it."""
    card = {"father": "p_father", "mother": "p_mother", "spouse": "p_spouse"}
    y = T.year_of("fecha")
    f = findings.select("id", "person", "names", "kind", "place", "homonym", y.alias("y"), F.when(T.event_class("kind") == "birth", y).alias("born"))
    asked = written(f.select(F.col("person").alias("name"), F.col("born").alias("year")).distinct(), "asked")
    who = decided(asked, people).where("person_id IS NOT NULL").select("name", "year", "person_id")
    p = people.select(F.col("id").alias("person_id"), "birth_year", T.norm("place").alias("home"), *[T.name_tokens(r).alias(f"{r}_t") for r in card])
    known = side(who.join(p.hint("merge"), "person_id").withColumn("own_t", T.name_tokens("name")), "known-people")
    # what surname words and places say
    surnames = people.select(F.explode(F.flatten(F.array(T.name_tokens("surname1"), T.name_tokens("surname2"), *[T.name_tokens(T.surname_of(r)) for r in card]))).alias("tok")).distinct()
    names = written(asked.select(F.col("name").alias("person")).distinct(), "person-names")
    words = side(names.select("person", F.explode(T.name_tokens("person")).alias("tok")).join(surnames.hint("merge"), "tok").groupBy("person").agg(F.count("*").alias("words")), "words")
    places = written(findings.select("place").distinct(), "places")
    met = places_met(places, "place", people.select(F.col("place").alias("home")), "home").select("place").distinct().withColumn("of_family", F.lit(True))
    places = side(places.join(met.hint("merge"), "place", "left").withColumn("there", T.norm("place")), "places-met")
    parents = confirmed_parents(findings, people)
    span = people.agg(F.min("birth_year").alias("lo"), F.max("birth_year").alias("hi")).first()  # two numbers
    lo, hi = ANY_YEAR if span.lo is None else (span.lo - GENERATION_WINDOW, span.hi + GENERATION_WINDOW)
    # known people by themselves: they are few, and most findings need no tokens
    j = f.join(known, (F.col("person") == F.col("name")) & F.col("born").eqNullSafe(F.col("year"))).join(places, "place", "left")
    others = F.array_join(F.coalesce("names", F.array().cast("array<string>")), " ")
    near = F.coalesce((F.col("there") != "") & (F.col("home") != "") & (F.contains("there", F.col("home")) | F.contains("home", F.col("there"))), F.lit(False))
    j = j.withColumn("others_t", T.name_tokens(others)).select("id", "person_id", "homonym", T.date_fit("y", "birth_year", "kind").alias("fit"), near.alias("near"), relative_named([*card]).alias("relative"))
    j = j.withColumn("facts", F.array_compact(F.array(F.lit("name"), F.when(F.col("fit") == 1, "date"), F.when(F.col("near"), "place"), F.col("relative"))))
    weak = F.col("homonym") | F.coalesce(F.col("fit") == -1, F.lit(False))
    known = side(j.select("id", "person_id", "facts", F.when(weak, "weak").when(F.size("facts") >= 2, "confirmed").otherwise("strong").alias("known")), "known-findings")
    j = f.select("id", "person", "place", "y").join(words, "person", "left").join(places, "place", "left").select("id", "person", "y", "words", "of_family")
    j = j.join(known, "id", "left").join(parents.hint("merge"), "id", "left")
    n = F.coalesce("words", F.lit(0))
    coherent = F.coalesce(F.when(n > 0, F.col("y").between(lo, hi)).otherwise(F.col("y").between(*ANY_YEAR)), F.lit(False))
    sure = F.col("father").isNotNull() & (T.parent_clash("y", "father_year", "mother_year") == "")
    new = F.when(sure, "confirmed").when((n >= 2) & F.col("of_family").isNotNull() & coherent, "strong").otherwise("weak")
    level = F.when(F.col("person_id").isNull(), new).otherwise(F.col("known"))
    told = F.when(level != "confirmed", F.array().cast("array<string>")).when(F.col("person_id").isNull(), F.array(F.lit("father"), F.lit("mother"))).otherwise(F.col("facts"))
    return j.select("id", "person", "person_id", level.alias("level"), told.alias("facts"), "father", "mother")


#: Parts that a surname's acts are dealt to, so that a common surname is not one task.
SALTS = 16


PROFILE = ["ag", "a1", "a2", "year", "mun"]


def act_profiles(acts: DataFrame) -> DataFrame:
    """id and what compatibility() looks at: given name, surnames, year and municipality, normalised."""
    return acts.select("id", T.norm("given").alias("ag"), T.norm("surname1").alias("a1"), T.norm("surname2").alias("a2"), "year", T.norm("municipality").alias("mun"))


def compatibility(acts: DataFrame, people: DataFrame) -> DataFrame:
    """PROFILE, acts, people, seq, score, verdict: of acts and people who share a surname (others are incompatible by
    rule), one row for each pair of distinct profiles, with how many acts and people have them and the smallest seq.

    Pairs grow with the distinct profiles, not with namesakes. They come from a join on each surname of either side,
    dealt to SALTS parts; a pair that shares both is kept at the first that they share, so nothing is shuffled again."""
    p = people.select("seq", T.norm("given").alias("pg"), T.norm("surname1").alias("p1"), T.norm("surname2").alias("p2"), "birth_year", T.norm("place").alias("home"))
    p = p.groupBy("pg", "p1", "p2", "birth_year", "home").agg(F.count("*").alias("people"), F.min("seq").alias("seq"))
    a = act_profiles(acts).groupBy(*PROFILE).agg(F.count("*").alias("acts"))
    left = a.withColumn("s", F.explode(F.array_distinct(F.filter(F.array("a1", "a2"), lambda x: x != "")))).withColumn("salt", F.pmod(F.xxhash64(*PROFILE), F.lit(SALTS)))
    right = p.withColumn("s", F.explode(F.array_distinct(F.array("p1", "p2")))).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    first = F.when((F.col("a1") != "") & ((F.col("a1") == F.col("p1")) | (F.col("a1") == F.col("p2"))), F.col("a1")).otherwise(F.col("a2"))
    pairs = left.join(right.hint("merge"), ["s", "salt"]).where(F.col("s") == first)
    common = ((F.col("p1") == F.col("a1")) | (F.col("p1") == F.col("a2"))).cast("int") + ((F.col("p2") == F.col("a1")) | (F.col("p2") == F.col("a2"))).cast("int")
    d = F.abs(F.col("year") - F.col("birth_year"))
    inside = F.contains("mun", F.col("home"))
    score = F.when((F.col("ag") == F.col("pg")) & (common == 2), 2.0).when(common >= 2, 1.0).otherwise(0.5) + F.when(d <= 5, 1).otherwise(0) + F.when((F.col("home") != "") & inside, 1).otherwise(0)
    reserve = F.coalesce((d.isNull() & F.col("year").isNotNull()) | (d > 5) | (F.col("home") == "") | ~inside, F.lit(False))
    verdict = F.when(F.coalesce(d > 25, F.lit(False)), "incompatible").when((score >= 2) & reserve, "reserves").when(score >= 2, "compatible").otherwise("insufficient")
    return pairs.select(*PROFILE, "acts", "people", "seq", score.alias("score"), verdict.alias("verdict"))


def counted_verdicts(acts: DataFrame, people: DataFrame) -> DataFrame:
    """verdict, n, score (their sum) over all pairs of compatibility(), which are counted and not made.

    What a pair scores depends on whether it shares both surnames, the given name, the distance in years and whether the
    act's municipality has the person's home in it. Pairs are counted by single surnames (s), by both surnames and by
    these with the given name, and what is counted twice is taken off; each side is summed by such a key, year and place
    first, so rows grow with distinct years within a key. Homes are met in a step of their own."""
    both = lambda x, y: F.array_sort(F.array_distinct(F.array(x, y)))
    p = people.select(T.norm("given").alias("g"), both(T.norm("surname1"), T.norm("surname2")).alias("ss"), "birth_year", T.norm("place").alias("home"))
    p = written(p.groupBy("g", "ss", "birth_year", "home").agg(F.count("*").alias("m")), "people-summed")
    a = act_profiles(acts).select(F.col("ag").alias("g"), both("a1", "a2").alias("ss"), F.array_distinct(F.filter(F.array("a1", "a2"), lambda x: x != "")).alias("own"), "year", "mun")
    a = written(a.groupBy("g", "ss", "own", "year", "mun").agg(F.count("*").alias("n")), "acts-summed")
    # keys: by a surname for people of two (1) and of one twice over (2), by both surnames (3); with the given name 4, 5
    at = lambda part, ss, g: F.struct(F.lit(part).alias("part"), ss.alias("of"), g.alias("g"))
    none, g = F.lit(""), F.col("g")
    two = F.size("ss") == 2
    of_act = F.concat(F.flatten(F.transform("own", lambda s: F.array(at(1, F.array(s), none), at(2, F.array(s), none), at(4, F.array(s), g)))), F.when(two, F.array(at(3, F.col("ss"), none), at(5, F.col("ss"), g))).otherwise(F.array().cast("array<struct<part:int,of:array<string>,g:string>>")))
    of_person = F.when(two, F.array(at(1, F.array(F.get("ss", 0)), none), at(1, F.array(F.get("ss", 1)), none), at(3, F.col("ss"), none), at(5, F.col("ss"), g))).otherwise(F.array(at(2, F.col("ss"), none), at(4, F.col("ss"), g)))
    key = ["part", "of", "g"]
    x = a.where(F.size("own") > 0).select(F.explode(of_act).alias("c"), "year", "mun", "n", (F.col("n") * F.size("own")).alias("w")).select("c.*", "year", "mun", "n", "w")
    y = p.select(F.explode(of_person).alias("c"), "birth_year", "home", "m").select("c.*", "birth_year", "home", "m")
    x = written(x.groupBy(*key, "year", "mun").agg(F.sum("n").alias("n"), F.sum("w").alias("w")), "acts-keyed")
    y = written(y.groupBy(*key, "birth_year", "home").agg(F.sum("m").alias("m")), "people-keyed")
    met = places_met(x.select("mun"), "mun", y.select("home"), "home").where(F.contains("mun", F.col("home")))
    d = F.abs(F.col("year") - F.col("birth_year"))
    far = F.when(F.col("year").isNull(), "undated").when(d.isNull(), "unknown").when(d <= 5, "near").when(d <= 25, "some").otherwise("far")

    def pairs(left, right, keys, where):
        j = left.join(right.hint("merge"), keys).select("part", far.alias("far"), where.alias("where"), (F.col("n") * F.col("m")).alias("n"), (F.col("w") * F.col("m")).alias("w"))
        return j.groupBy("part", "far", "where").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))

    summed = [F.sum("n").alias("n"), F.sum("w").alias("w")]
    homed = F.when(F.col("has_home"), "out").otherwise("none")
    everywhere = pairs(x.groupBy(*key, "year").agg(*summed), y.groupBy(*key, "birth_year", (F.col("home") != "").alias("has_home")).agg(F.sum("m").alias("m")), key, homed)
    inside = pairs(x.join(met.hint("merge"), "mun").groupBy(*key, "year", "home").agg(*summed), y, [*key, "home"], F.lit("in"))
    counts = everywhere.unionByName(inside).unionByName(inside.select("part", "far", F.lit("out").alias("where"), (-F.col("n")).alias("n"), (-F.col("w")).alias("w")))
    # what each count says of pairs that share one surname (0.5), both (1.0), both and the given name (2.0)
    says = lambda base, n: F.struct(F.lit(base).alias("base"), n.alias("n"))
    n, w = F.col("n"), F.col("w")
    part = F.when(F.col("part") == 1, F.array(says(0.5, n))).when(F.col("part") == 2, F.array(says(1.0, n))).when(F.col("part") == 3, F.array(says(1.0, n), says(0.5, -w))).otherwise(F.array(says(2.0, n), says(1.0, -n)))
    c = counts.select("far", "where", F.explode(part).alias("x")).groupBy("far", "where", "x.base").agg(F.sum("x.n").alias("n")).where("n <> 0")
    score = F.col("base") + (F.col("far") == "near").cast("int") + (F.col("where") == "in").cast("int")
    reserve = F.col("far").isin("unknown", "some", "far") | (F.col("where") != "in")
    verdict = F.when(F.col("far") == "far", "incompatible").when((score >= 2) & reserve, "reserves").when(score >= 2, "compatible").otherwise("insufficient")
    return c.groupBy(verdict.alias("verdict")).agg(F.sum("n").alias("n"), F.sum(score * F.col("n")).alias("score"))


def best_people(acts: DataFrame, people: DataFrame) -> DataFrame:
    """id, seq, rank, score of the person whom compatibility() fits best to an act: the best verdict, then the most
    points, then the smallest seq.

    For every choice of what a pair may share (a surname; both; both and the given name; with the home or without) the
    smallest seq within 5 years, within 25 or without a year, and of all is looked up by distinct keys. A lookup never
    claims more than its person has, so the best claim is the right one; pairs are made only of the distinct years of a key."""
    both = lambda x, y: F.array_sort(F.array_distinct(F.array(x, y)))
    none, g = F.lit(""), F.col("g")
    at = lambda base, ss, given: F.struct(F.lit(base).alias("base"), ss.alias("of"), given.alias("g"))
    p = people.select("seq", T.norm("given").alias("g"), both(T.norm("surname1"), T.norm("surname2")).alias("ss"), "birth_year", T.norm("place").alias("home"))
    keys = F.concat(F.transform("ss", lambda s: at(0.5, F.array(s), none)), F.array(at(1.0, F.col("ss"), none), at(2.0, F.col("ss"), g)))
    y = written(p.select("seq", "birth_year", "home", F.explode(keys).alias("c")).groupBy("c", "birth_year", "home").agg(F.min("seq").alias("seq")), "people-keyed")
    # both surnames: those of the act, or one of them that a person has twice over
    a = act_profiles(acts).select("id", F.col("ag").alias("g"), both("a1", "a2").alias("ss"), F.array_distinct(F.filter(F.array("a1", "a2"), lambda x: x != "")).alias("own"), "year", "mun")
    full = F.array_distinct(F.concat(F.array("ss"), F.transform("own", lambda s: F.array(s))))
    wanted = F.concat(F.transform("own", lambda s: at(0.5, F.array(s), none)), F.flatten(F.transform(full, lambda ss: F.array(at(1.0, ss, none), at(2.0, ss, g)))))
    profile = ["g", "ss", "own", "year", "mun"]
    each = a.where(F.size("own") > 0).select(profile).distinct().withColumn("c", F.explode(wanted))
    met = places_met(acts.select(T.norm("municipality").alias("mun")), "mun", people.select(T.norm("place").alias("home")), "home").where(F.contains("mun", F.col("home")))
    homes = written(met, "homes")

    def looked(x, y, keys, here):
        """keys, year and m: the best (rank, less, seq) of a lookup."""
        d = F.abs(F.col("year") - F.col("birth_year"))
        points = F.col("c")["base"] + here
        dated = F.when(d <= 5, F.struct(F.when(points + 1 < 2, 2).otherwise(1 - here).alias("rank"), (-points - 1).alias("less"), "seq"))
        same = F.when(points < 2, 2).otherwise(1)
        some = F.when(d.isNull() | (d <= 25), F.struct(F.when(F.col("year").isNull() & (points >= 2), 1 - here).otherwise(same).alias("rank"), (-points).alias("less"), "seq"))
        rest = F.struct(F.lit(3).alias("rank"), (-points).alias("less"), F.col("seq"))
        j = x.select(*keys, "year").distinct().join(y.hint("merge"), keys)
        return j.groupBy(*keys, "year").agg(F.min(F.coalesce(dated, some, rest)).alias("m"))

    nearby = y.join(homes.hint("merge"), "home").groupBy("c", "birth_year", "mun").agg(F.min("seq").alias("seq"))
    found = None
    for keys, cards, here in ((["c"], y.groupBy("c", "birth_year").agg(F.min("seq").alias("seq")), 0), (["c", "mun"], nearby, 1)):
        m = looked(each, cards, keys, here).withColumnRenamed("year", "y")
        on = [F.col(f"x.{k}") == F.col(f"m.{k}") for k in keys] + [F.col("x.year").eqNullSafe(F.col("m.y"))]
        got = each.alias("x").join(m.alias("m").hint("merge"), on).select(*[f"x.{c}" for c in profile], "m.m")
        found = got if found is None else found.unionByName(got)
    best = found.groupBy(profile).agg(F.min("m").alias("m")).select(*[F.col(c).alias(f"b_{c}") for c in profile], "m")
    return a.join(best.hint("merge"), [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in profile]).select("id", "m.seq", F.col("m.rank").alias("rank"), (-F.col("m.less")).alias("score"))


def fitting_acts(people: DataFrame, acts: DataFrame, lo: int, hi: int, most: int) -> DataFrame:
    """seq, id, points, far of the `most` baptisms that best fit a person, by most points, then nearest, then the smallest
    id: parish, municipality and second surname give points; far is the distance to the middle of the window.

    A search is made for every choice of these three, and only the first `most` acts of each are taken: an act that is
    among the best has at most that many before it in the search for just what it shares, and none has fewer points there
    than the search says. Searches and acts of one key and year are reduced first, so nothing grows with pairs of namesakes."""
    q = people.where("birth_year IS NOT NULL").select("seq", T.given_key("given").alias("k"), T.norm("surname1").alias("s"), T.norm("surname2").alias("s2"), T.norm("place").alias("home"), (F.col("birth_year") + lo).alias("lo"), (F.col("birth_year") + hi).alias("hi"))
    a = acts.where("kind = 'bautismo' AND year IS NOT NULL").select("id", "year", T.given_key("given").alias("k"), T.norm("surname1").alias("s"), T.norm("surname2").alias("s2"), T.norm("parish").alias("parish"), T.norm("municipality").alias("mun"))
    inside = written(places_met(a.select("parish"), "parish", q.select("home"), "home").where(F.contains("parish", F.col("home"))).groupBy("parish").agg(F.collect_set("home").alias("homes")), "parishes")
    choice = lambda two, place, s2, home: F.struct(F.lit(two).alias("two"), F.lit(place).alias("place"), s2.alias("c2"), home.alias("at"))
    none = F.lit("")
    seconds = lambda place, home: F.array(choice(0, place, none, home), F.when(F.col("s2") != "", choice(2, place, F.col("s2"), home)))
    # an act: of any place, of its municipality (2), of a home that its parish names (3) or both (5)
    homes = F.coalesce("homes", F.array().cast("array<string>"))
    both = F.when(F.array_contains(homes, F.col("mun")), F.col("mun"))
    of_act = F.concat(seconds(0, none), seconds(2, F.col("mun")), F.flatten(F.transform(homes, lambda h: seconds(3, h))), F.when(both.isNotNull(), seconds(5, both)).otherwise(F.array().cast("array<struct<two:int,place:int,c2:string,at:string>>")))
    key = ["k", "s", "two", "place", "c2", "at"]
    first = lambda df, keys, *order: df.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("r") <= most).drop("r")
    there = a.join(inside.hint("merge"), "parish", "left").select("id", "year", "k", "s", F.explode(F.array_compact(of_act)).alias("c")).select("id", "year", "k", "s", "c.*")
    home = F.col("home")
    of_person = F.concat(seconds(0, none), seconds(2, home), *[F.when(home != "", seconds(n, home)).otherwise(F.array().cast("array<struct<two:int,place:int,c2:string,at:string>>")) for n in (3, 5)])
    profile = ["k", "s", "s2", "home", "lo", "hi"]
    each = q.select(profile).distinct().select("*", F.explode(F.array_compact(of_person)).alias("c")).select(*profile, "c.*")
    far = F.abs(F.col("year") - (F.col("lo") + F.col("hi")) / 2)
    found = in_window(each.select(*key, "lo", "hi").distinct(), "lo", "hi", first(there, [*key, "year"], "id"), "year", key).withColumn("far", far)
    found = first(found, [*key, "lo", "hi"], "far", "id").select(*key, "lo", "hi", "id", "far")
    best = each.join(found.hint("merge"), [*key, "lo", "hi"]).groupBy(*profile, "id", "far").agg(F.max(F.col("two") + F.col("place")).alias("points"))
    return q.join(first(best, profile, F.desc("points"), "far", "id").hint("merge"), profile).select("seq", "id", "points", "far")


def pick_act(people: DataFrame, acts: DataFrame, lo: int, hi: int) -> DataFrame:
    """seq, id, points, confidence of the baptism that best fits a person: most points, then nearest, then the smallest id."""
    scored = fitting_acts(people, acts, lo, hi, 1)
    best = first_by(scored, ["seq"], F.desc("points"), "far", "id")
    return best.select("seq", "id", "points", F.when(F.col("points") >= 3, "high").when(F.col("points") >= 2, "mid").otherwise("low").alias("confidence"))


def seals(acts: DataFrame, kin: DataFrame) -> DataFrame:
    """id, seal of every act against a family: a named relative is a record; surnames, time and place add up to
    a reserved one from 2 on; else a hint."""
    known = kin.select(T.norm("surname1").alias("s")).distinct()
    relatives = kin.select(T.given_key("given").alias("g"), T.norm("surname1").alias("s")).where("g <> ''").distinct().withColumn("named", F.lit(True))
    places = kin.select(T.norm("place").alias("mun")).where("mun <> ''").distinct().withColumn("near", F.lit(True))
    span = kin.agg((F.min("birth_year") - 110).alias("lo"), (F.max("birth_year") + 50).alias("hi")).first()  # two numbers
    a = acts.select("id", T.norm("surname1").alias("s1"), T.norm("surname2").alias("s2"), "year", T.norm("municipality").alias("mun"), T.given_key("father_given").alias("g"), T.norm("father_surname").alias("s"))
    hit = lambda c: known.select(F.col("s").alias(c), F.lit(1).alias("k_" + c)).hint("merge")
    j = a.join(hit("s1"), "s1", "left").join(hit("s2"), "s2", "left").join(relatives.hint("merge"), ["g", "s"], "left").join(places.hint("merge"), "mun", "left")
    k = F.coalesce("k_s1", F.lit(0)) + F.when(F.col("s2") != "", F.coalesce("k_s2", F.lit(0))).otherwise(0)
    points = F.when(k == 2, 1.0).when(k == 1, 0.5).otherwise(0.0) + F.coalesce(F.col("year").between(span.lo, span.hi), F.lit(False)).cast("int") + F.coalesce("near", F.lit(False)).cast("int")
    return j.select("id", F.when(F.col("named"), "record").when(points >= 2, "reserved").otherwise("hint").alias("seal"))


def other_acts(people: DataFrame, acts: DataFrame, lo: int, hi: int, most: int = 5) -> DataFrame:
    """seq, place (from 1), id of the next best baptisms after the one that pick_act() takes."""
    w = Window.partitionBy("seq").orderBy(F.desc("points"), "far", "id")
    ranked = fitting_acts(people, acts, lo, hi, most + 1).withColumn("place", F.row_number().over(w) - 1)
    return ranked.where(F.col("place").between(1, most)).select("seq", "place", "id")
