"""Column expressions for names, dates and keys (all built-in functions, so they stay in generated code)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of name tokens, particles of surnames, very common surnames.
STOPWORDS = ["a", "da", "de", "del", "do", "e", "el", "en", "la", "las", "los", "y"]
PARTICLES = ["d", "da", "das", "de", "del", "dela", "di", "do", "dos", "du", "e", "el", "la", "las", "los", "van", "von", "y"]
COMMON_SURNAMES = (
    "alonso alvarez blanco calvo cano carrera castillo castro cortes cruz delgado diaz dominguez fernandez flores gallego garcia garrido "
    "gil gomez gonzalez guerrero gutierrez hernandez herrera herrero iglesias jimenez leon lopez lozano marin martin martinez medina mendez merino molina "
    "montero morales moreno navarro ortega ortiz pascual perez prieto ramirez ramos rodriguez romero rubio ruiz sanchez santos sanz "
    "serrano suarez torres vazquez vega vidal"
).split()
# Months by name and as they are written in a family-graph date.
MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
MONTHS_OUT = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()


@lru_cache(maxsize=2)
def accent_map(lower: bool) -> tuple[str, str]:
    """Letters with marks and their plain letters, from the Unicode decompositions up to U+1EFF."""
    pairs = []
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(cp) and not (lower and chr(cp) != chr(cp).lower()):
            pairs.append((chr(cp), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm(c: Column | str) -> Column:
    """Lower case, no accents, single spaces, trimmed; null is ''."""
    x = F.translate(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"\p{M}+", ""), *accent_map(True))
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def plain(c: Column | str) -> Column:
    """Without accents, case kept."""
    return F.translate(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\p{M}+", ""), *accent_map(False))


def short_hash(c: Column | str) -> Column:
    return F.substring(F.sha2(F.coalesce(col(c), F.lit("")), 256), 1, 16)


def year_of(c: Column | str, floor: int = 1400) -> Column:
    """The first plausible year from `floor` to 2099 in free text, or null."""
    pattern = r"(1[4-9]\d\d|20\d\d)" if floor == 1400 else r"(1[5-9]\d\d|20\d\d)"
    return F.nullif(F.regexp_extract(F.coalesce(col(c), F.lit("")), pattern, 1), F.lit("")).cast("int")


def name_tokens(c: Column | str) -> Column:
    """Distinct significant words of a name: over two letters, no stop words."""
    return F.array_distinct(F.filter(F.split(norm(c), " "), lambda t: (F.length(t) > 2) & ~t.isin(STOPWORDS)))


def surname_tokens(c: Column | str) -> Column:
    """Words of a surname as written, without particles and short ones."""
    return F.filter(F.split(F.trim(F.coalesce(col(c), F.lit(""))), r"\s+"), lambda t: (F.length(t) > 2) & ~F.lower(F.translate(t, *accent_map(False))).isin(PARTICLES))


def given_key(c: Column | str) -> Column:
    """Key of a given name under old spelling: v as b, y as i, no h, doubled letters once."""
    return F.regexp_replace(F.translate(norm(c), "vyh", "bi"), r"(.)\1+", "$1")


def same_given(a: Column | str, b: Column | str) -> Column:
    return (norm(a) != "") & (norm(b) != "") & (given_key(a) == given_key(b))


def same_surname(a: Column | str, b: Column | str) -> Column:
    """Equal, or equal with hyphens as spaces, or one of at least 4 letters within the other."""
    x, y = F.replace(norm(a), F.lit("-"), F.lit(" ")), F.replace(norm(b), F.lit("-"), F.lit(" "))
    return (x != "") & (y != "") & ((x == y) | ((F.length(x) >= 4) & (F.length(y) >= 4) & (F.contains(x, y) | F.contains(y, x))))


def same_place(a: Column | str, b: Column | str) -> Column:
    x, y = norm(a), norm(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def subset(a: Column, b: Column) -> Column:
    """Whether a, not empty, is within b."""
    return (F.size(a) > 0) & (F.size(F.array_except(a, b)) == 0)


def names_match(a: Column | str, b: Column | str) -> Column:
    """Equal, or the tokens of one within those of the other."""
    x, y = name_tokens(a), name_tokens(b)
    return (norm(a) != "") & (norm(b) != "") & ((norm(a) == norm(b)) | (F.size(x) > 0) & (F.size(y) > 0) & (subset(x, y) | subset(y, x)))


def anchor_match(a: Column | str, b: Column | str) -> Column:
    """One within the other as text, or all raw words of one among those of the other."""
    x, y = norm(a), norm(b)
    u, v = F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x) | subset(u, v) | subset(v, u))


def spelling_forms(c: Column | str) -> Column:
    """Forms of a surname worth searching, in order and distinct; for one token the name and its plain form."""
    name = F.trim(F.coalesce(col(c), F.lit("")))
    t = surname_tokens(name)
    a, b = F.get(t, 0), F.get(t, 1)
    joined = F.array_join(t, " ")
    singles = F.flatten(F.transform(t, lambda x: F.array(x, plain(x))))
    two = F.array(F.concat_ws("-", a, b), plain(F.concat_ws("-", a, b)), F.concat_ws(" ", b, a), plain(F.concat_ws(" ", b, a)), F.concat_ws("-", b, a))
    none = F.array().cast("array<string>")
    many = F.concat(F.array(name, plain(name)), singles, F.array(joined, plain(joined)), F.when(F.size(t) == 2, two).otherwise(none))
    return F.when(name == "", none).otherwise(F.array_distinct(F.when(F.size(t) <= 1, F.array(name, plain(name))).otherwise(many)))


def wildcard(c: Column | str) -> Column:
    """Accented letters as the one-character wildcard of LIKE."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), "[áéíóúüñÁÉÍÓÚÜÑ]", "_")


#: Words that say that a name is not known, and marks that may stand around one.
UNKNOWN_NAME = ["desconocid", "ignorad", "no consta", "sin nombre", "padres"]
NAME_EDGES = ",.;:¿?¡!\"'()"


def clean_name(c: Column) -> Column:
    """A candidate name in single spaces and without marks around it; '' if it is shorter than three characters,
    has no letter or says that the name is unknown."""
    name = F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), F.lit(NAME_EDGES + " "))
    unknown = F.exists(F.array(*[F.lit(w) for w in UNKNOWN_NAME]), lambda w: F.contains(F.lower(name), w))
    return F.when((F.length(name) >= 3) & (F.lower(name) != F.upper(name)) & ~unknown, name).otherwise("")


def distinct_by_norm(names: Column) -> Column:
    """The first of each normalised form, in order."""
    return F.filter(names, lambda x, i: F.array_position(F.transform(names, norm), norm(x)) == i + 1)


def names_with_role(names: Column | str, *roles: str) -> Column:
    """Names written as 'Name (role)', clean and distinct."""
    pattern = r"(?i)^\s*([^()]+?)\s*\((?:es\s+)?(?:su\s+)?(?:" + "|".join(roles) + r")\)"
    found = F.transform(F.coalesce(col(names), F.array().cast("array<string>")), lambda n: clean_name(F.regexp_extract(F.trim(n), pattern, 1)))
    return distinct_by_norm(F.filter(found, lambda n: n != ""))


#: What follows "child" up to the next mark, and the most words of a name in it.
CHILD_CLAUSE, NAME_WORDS = r"(?i)\bhij(?:os|as|o|a)\b([^,.;:()\n]*)", 6


def parent_pairs(text: Column | str) -> Column:
    """(father, mother) of every 'child of X and Y' phrase: of the words after "child", those between the first
    "de" and the next "y" (what stands before that "de" only qualifies the child) and the NAME_WORDS after it,
    without a "de" in front."""
    clauses = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(CHILD_CLAUSE), F.lit(1))

    def pair(clause: Column) -> Column:
        rest = F.regexp_replace(clause, r"(?i)^.*?\sde\s+", "")
        halves = F.split(rest, r"(?i)\s+y\s+", 2)
        mother = F.regexp_replace(F.coalesce(F.get(halves, 1), F.lit("")), r"(?i)^de\s+", "")
        named = F.when(clause.rlike(r"(?i)\sde\s+"), F.get(halves, 0)).otherwise("")
        return F.struct(clean_name(named).alias("father"), clean_name(F.array_join(F.slice(F.split(mother, r"\s+"), 1, NAME_WORDS), " ")).alias("mother"))

    return F.filter(F.transform(clauses, pair), lambda p: (p["father"] != "") & (p["mother"] != ""))


def parent_of(names: Column | str, quote: Column | str, role: str) -> Column:
    """The one parent that a finding names for a role: by role mark or phrase, else by the quotation's
    phrase; with two different candidates null, never a guess."""
    side = "father" if role == "padre" else "mother"
    n = F.coalesce(col(names), F.array().cast("array<string>"))
    phrased = F.flatten(F.transform(n, lambda x: F.transform(parent_pairs(x), lambda p: p[side])))
    first = distinct_by_norm(F.concat(names_with_role(n, role), phrased))
    last = distinct_by_norm(F.transform(parent_pairs(quote), lambda p: p[side]))
    return F.when(F.size(first) == 1, F.get(first, 0)).when(F.size(first) == 0, F.when(F.size(last) == 1, F.get(last, 0)))


def parents_told(text: Column | str) -> Column:
    """What one text says of parents: an array of (role, phrase, at, name): the role mark 'Name (role)' (phrase 0), then
    the pairs of its 'child of X and Y' phrases (phrase 1) in order. Names are clean and not empty."""
    x = F.coalesce(col(text), F.lit(""))
    mark = r"(?i)^\s*([^()]+?)\s*\((?:es\s+)?(?:su\s+)?(padre|madre)\)"
    one = lambda role, phrase, at, name: F.struct(role.alias("role"), F.lit(phrase).alias("phrase"), at.alias("at"), name.alias("name"))
    none = F.array().cast("array<struct<role:string,phrase:int,at:int,name:string>>")
    marked = F.when(x.rlike(mark), F.array(one(F.lower(F.regexp_extract(F.trim(x), mark, 2)), 0, F.lit(0), clean_name(F.regexp_extract(F.trim(x), mark, 1))))).otherwise(none)
    phrased = F.when(x.rlike("(?i)hij"), F.flatten(F.transform(parent_pairs(x), lambda p, j: F.array(one(F.lit("padre"), 1, j, p["father"]), one(F.lit("madre"), 1, j, p["mother"]))))).otherwise(none)
    return F.filter(F.concat(marked, phrased), lambda c: c["name"] != "")


#: Words for a birth, a death and a marriage.
BIRTHS = ["nacimiento", "nacer", "bautismo", "bautizo", "bautismos"]
DEATHS = ["defuncion", "fallecimiento", "entierro", "difunto", "muerte"]
MARRIAGES = ["matrimonio", "boda", "casamiento"]


def event_class(c: Column | str) -> Column:
    # words that are written plainly need no normal form
    t, plainly = norm(c), F.lower(F.coalesce(col(c), F.lit("")))
    told = F.when(plainly.isin(BIRTHS), "birth").when(plainly.isin(DEATHS), "death").when(plainly.isin(MARRIAGES), "marriage")
    return told.when(t.isin(BIRTHS), "birth").when(t.isin(DEATHS), "death").when(t.rlike("|".join(MARRIAGES)), "marriage").otherwise(t)


def surname_of(c: Column | str) -> Column:
    """All after the first word; a single word is its own surname."""
    t = F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " "))
    return F.when(F.contains(t, F.lit(" ")), F.regexp_extract(t, r"^\S+ (.*)$", 1)).otherwise(t)


def rarity(c: Column | str, common: list[str] = COMMON_SURNAMES) -> Column:
    """0 common or empty, 1 with a common word, 3 rare."""
    t = norm(c)
    words = F.filter(F.split(t, " "), lambda x: ~x.isin(STOPWORDS))
    return F.when((t == "") | t.isin(common), 0).when(F.exists(words, lambda x: x.isin(common)), 1).otherwise(3)


def usable_surname(c: Column | str) -> Column:
    return (F.length(norm(c)) > 2) & ~norm(c).isin(COMMON_SURNAMES)


def graph_date(c: Column | str) -> Column:
    """A free-text date as DAY MON YEAR, with less where less is known, ABT for a bare year, else ''."""
    t = norm(c)
    iso = lambda k: F.regexp_extract(t, r"(\d{4})-(\d{1,2})(?:-(\d{1,2}))?", k)
    words = lambda k: F.regexp_extract(t, r"(?:(\d{1,2}) ?de )?([a-z]+) ?(?:del? )?(\d{4})", k)
    months = F.array(*[F.lit(m) for m in MONTHS_OUT])
    day = lambda d: F.when(d != "", F.concat(d.cast("int").cast("string"), F.lit(" "))).otherwise("")
    m1 = iso(2).try_cast("int")
    m2 = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), words(2)).cast("int")
    return (F.when((iso(1) != "") & m1.between(1, 12), F.concat(day(iso(3)), F.get(months, m1 - 1), F.lit(" "), iso(1)))
            .when(m2 > 0, F.concat(day(words(1)), F.get(months, m2 - 1), F.lit(" "), words(3))).when(t.rlike(r"^\d{4}$"), F.concat(F.lit("ABT "), t)).otherwise(""))


def evidence_key(kind: Column | str, date: Column | str, place: Column | str, url: Column | str, quote: Column | str, origin: Column | str) -> Column:
    """Stable key of an evidence: what it says and where, never when it was committed."""
    return F.concat_ws("|", norm(kind), norm(date), norm(place), F.trim(F.coalesce(col(url), F.lit(""))), norm(F.substring(col(quote), 1, 400)), norm(origin))


def person_key(given: Column | str, surname: Column | str, suffix: Column | str | None = None) -> Column:
    base = norm(F.concat_ws(" ", given, surname))
    return base if suffix is None else F.concat(base, F.lit("::"), F.coalesce(col(suffix).cast("string"), F.lit("")))


def pair_key(a: Column | str, b: Column | str) -> Column:
    """Key of a couple, whoever comes first."""
    return F.array_join(F.array_sort(F.array(col(a), col(b))), "||")


def date_fit(year: Column | str, birth: Column | str, kind: Column | str) -> Column:
    """1 coherent, 0 neither, -1 a contradiction; null if a year is unknown."""
    d, k = col(year) - col(birth), event_class(kind)
    return (F.when(d.isNull(), None).when(k == "birth", F.when(F.abs(d) <= 8, 1).otherwise(-1)).when(k == "death", F.when(d.between(0, 110), 1).otherwise(-1))
            .otherwise(F.when(d.between(6, 90), 1).when((d < -4) | (d > 110), -1).otherwise(0)))


def parent_clash(year: Column | str, father_birth: Column | str, mother_birth: Column | str) -> Column:
    """The reason why the couple can't be parents at that time, '' if none; a missing year never vetoes."""
    f, m = col(year) - col(father_birth), col(year) - col(mother_birth)
    return F.coalesce(F.when(~f.between(13, 80), "father"), F.when(~m.between(13, 55), "mother"), F.lit(""))
