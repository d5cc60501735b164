"""Domain tables made from the driver's tables, as SQL that says the same in Spark and in DuckDB.

A customer's key is a place in a heap: the father of m is 2m, the mother 2m + 1, so that every table
can name its people by arithmetic alone. All names are invented or very common."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GIVEN = ["Eusevio", "Yluminada", "Hilario", "Jullian", "Anna", "Benita", "Tomás", "Íñigo", "Petra", "Vicenta", "Bernabé", "Ysidra", "Mathías", "Lucía", "Ruperta", "Celso", "Damián", "Elvira", "Faustino", "Genoveva", "Blas", "Nicolás", "Zoilo"]
SURNAMES = ["Arbelu", "Sáez de Torrealba", "García", "Ochandio", "López", "Urrunaga", "Vélez-Mena", "Peñalta", "Moreno", "Quijorna", "Iturmendi", "Ruiz de Almansa", "Cabrejas", "Dehesa", "Escoriza", "Fuenmayor", "Gil", "Hontoria", "Yllanes", "Jaramago", "Lezcano", "Monteagudo", "Núñez", "Otáñez", "Pérez", "Redondal", "Salvatierra", "Toranzo", "Ubierna", "Valdivar", "Zabalburu"]


def _pick(values: list[str], at: str, duck: bool) -> str:
    items = ", ".join(f"'{v}'" for v in values)
    return f"list_extract([{items}], CAST({at} AS BIGINT) % {len(values)} + 1)" if duck else f"element_at(array({items}), CAST({at} % {len(values)} AS INT) + 1)"


def _given(m: str, duck: bool) -> str:
    return _pick(GIVEN, f"({m})", duck)


def _odd(m: str, duck: bool) -> str:
    return f"(({m}) >> bit_count((({m}) & -({m})) - 1))" if duck else f"shiftright({m}, CAST(bit_count((({m}) & -({m})) - 1) AS INT))"


def _surname(m: str, duck: bool) -> str:
    return _pick(SURNAMES, f"({_odd(m, duck)} * 7)", duck)


def _name(m: str, duck: bool) -> str:
    return f"concat({_given(m, duck)}, ' ', {_surname(m, duck)})"


def _year(m: str) -> str:
    return f"CAST(1895 - 28 * (length(bin({m})) - 1) - (({m}) - 1) % 5 AS INT)"


def _list(items: list[str], duck: bool) -> str:
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)" if duck else f"filter(array({', '.join(items)}), x -> x IS NOT NULL)"


class _Early:
    """Name parts by the place m of a card. For Spark they are columns made beside the customers, once a card and not once
    an act, and apart from what is made of them: one generated method for all is too large for the JVM to compile."""

    def __init__(self, duck: bool):
        self.duck, self.columns = duck, {}

    def _at(self, f, m: str) -> str:
        text = f(m, self.duck)
        return text if self.duck else self.columns.setdefault(text, f"part{len(self.columns)}")

    def given(self, m: str) -> str:
        return self._at(_given, m)

    def surname(self, m: str) -> str:
        return self._at(_surname, m)

    def name(self, m: str) -> str:
        return _name(m, True) if self.duck else f"concat({self.given(m)}, ' ', {self.surname(m)})"

    def customers(self) -> str:
        """The customers with m and the parts asked for."""
        parts = "".join(f", {text} AS {name}" for text, name in self.columns.items())
        return f"(SELECT c_custkey, c_nationkey, m{parts} FROM (SELECT c_custkey, c_nationkey, c_custkey + 1 AS m FROM {{customer}}))"


def people(duck: bool) -> str:
    early = _Early(duck)
    n, s, g = early.name, early.surname, early.given
    text = f"""SELECT m AS seq, concat('P', CAST(m AS VARCHAR(20))) AS id, concat({n('m')}, ' ', {s('2 * m + 1')}) AS name, {g('m')} AS given, {s('m')} AS surname1, {s('2 * m + 1')} AS surname2,
 CASE WHEN m % 7 <> 0 THEN {_year('m')} END AS birth_year, CASE WHEN m % 7 <> 0 THEN CASE m % 3 WHEN 0 THEN CAST({_year('m')} AS VARCHAR(10)) WHEN 1 THEN concat(CAST({_year('m')} AS VARCHAR(10)), '-03-', CAST(10 + m % 9 AS VARCHAR(2))) ELSE concat(CAST(1 + m % 27 AS VARCHAR(2)), ' de mayo de ', CAST({_year('m')} AS VARCHAR(10))) END ELSE '' END AS birth_date,
 CASE WHEN m % 11 <> 0 THEN n_name ELSE '' END AS place, CASE WHEN m % 13 <> 0 THEN r_name ELSE '' END AS province,
 CASE WHEN 2 * m <= total THEN {n('2 * m')} ELSE '' END AS father, CASE WHEN 2 * m + 1 <= total THEN {n('2 * m + 1')} ELSE '' END AS mother,
 CASE WHEN m > 1 THEN {n('(CASE WHEN m % 2 = 0 THEN m + 1 ELSE m - 1 END)')} ELSE '' END AS spouse, CASE WHEN m > 1 THEN {n('(m - m % 2) // 2' if duck else 'CAST((m - m % 2) / 2 AS BIGINT)')} ELSE '' END AS child,
 CASE WHEN m % 8 IN (0, 1, 3, 6) THEN 1 + m % 2 ELSE 0 END AS n_evidence, CASE WHEN m % 5 = 0 THEN concat('nacido hacia ', CAST({_year('m')} + 1 AS VARCHAR(10))) ELSE '' END AS notes
 FROM """
    cards = "(SELECT c_custkey + 1 AS m, c_nationkey, (SELECT count(*) FROM {customer}) AS total FROM {customer})" if duck else f"(SELECT *, (SELECT count(*) FROM {{customer}}) AS total FROM {early.customers()})"
    return f"{text}{cards} JOIN {{nation}} ON n_nationkey = c_nationkey JOIN {{region}} ON r_regionkey = n_regionkey"


def acts(duck: bool) -> str:
    early = _Early(duck)
    s, g = early.surname, early.given
    old = "CASE WHEN k % 5 = 2 THEN replace(replace({0}, 'v', 'b'), 'i', 'y') ELSE {0} END"
    kid = f"CASE WHEN k % 9 = 0 THEN {g('m')} ELSE {_given('k', duck)} END"
    text = f"""SELECT k AS id, kind, CASE WHEN k % 17 <> 0 THEN yr END AS year, CASE WHEN k % 17 <> 0 THEN concat(CAST(yr AS VARCHAR(10)), '-0', CAST(1 + k % 9 AS VARCHAR(2)), '-1', CAST(k % 10 AS VARCHAR(2))) ELSE '' END AS fecha,
 CASE kind WHEN 'bautismo' THEN {old.format('(' + kid + ')')} WHEN 'matrimonio' THEN {g('2 * m')} ELSE {g('m')} END AS given, CASE kind WHEN 'matrimonio' THEN {s('2 * m')} ELSE {s('m')} END AS surname1, CASE WHEN kind = 'matrimonio' OR k % 4 = 0 THEN '' ELSE {s('2 * m + 1')} END AS surname2,
 CASE WHEN kind = 'bautismo' AND 2 * m <= total THEN {g('2 * m')} ELSE '' END AS father_given, CASE WHEN kind = 'bautismo' AND 2 * m <= total THEN {s('2 * m')} ELSE '' END AS father_surname,
 CASE WHEN kind = 'bautismo' AND 2 * m + 1 <= total AND k % 10 <> 3 THEN {g('2 * m + 1')} ELSE '' END AS mother_given, CASE WHEN kind = 'bautismo' AND 2 * m + 1 <= total AND k % 10 <> 3 THEN {s('2 * m + 1')} ELSE '' END AS mother_surname,
 CASE WHEN kind = 'matrimonio' THEN {g('2 * m + 1')} ELSE '' END AS spouse_given, CASE WHEN kind = 'matrimonio' THEN {s('2 * m + 1')} ELSE '' END AS spouse_surname,
 n_name AS municipality, CASE WHEN k % 6 = 0 THEN '' ELSE concat('San ', CAST(k % 4 AS VARCHAR(2)), ' de ', n_name) END AS parish, r_name AS province, concat('F', CAST(k % 37 AS VARCHAR(4))) AS fonds, CASE WHEN k % 8 = 0 THEN '' ELSE concat('S/', CAST(k % 101 AS VARCHAR(4))) END AS shelfmark, CASE WHEN k % 3 = 0 THEN '' ELSE CAST(k % 300 AS VARCHAR(4)) END AS folio, {s('4 * m + 1')} AS father_surname2, {s('4 * m + 3')} AS mother_surname2
 FROM """
    m, parts = ("o_custkey + 1 AS m", "") if duck else ("m", "".join(f", {c}" for c in early.columns.values()))
    customers = "{customer}" if duck else early.customers()
    orders = f"""(SELECT o_orderkey AS k, {m}, CASE WHEN o_orderkey % 3 = 0 THEN 'bautismo' WHEN o_orderkey % 3 = 1 AND o_custkey % 6 <> 0 THEN 'matrimonio' ELSE 'defuncion' END AS kind, {_year('(o_custkey + 1)')} + CAST(o_orderkey % 8 AS INT) + CASE WHEN o_orderkey % 3 = 2 THEN 60 ELSE 0 END AS yr, c_nationkey, (SELECT count(*) FROM {{customer}}) AS total{parts} FROM {{orders}} JOIN {customers} ON c_custkey = o_custkey)"""
    return f"{text}{orders}\n JOIN {{nation}} ON n_nationkey = c_nationkey JOIN {{region}} ON r_regionkey = n_regionkey"


def findings(duck: bool) -> str:
    names = _list(["CASE WHEN father_given <> '' THEN concat(father_given, ' ', father_surname, CASE WHEN id % 2 = 0 THEN concat(' ', father_surname2) ELSE '' END, ' (padre)') END", "CASE WHEN mother_given <> '' THEN concat(mother_given, ' ', mother_surname, CASE WHEN id % 2 = 0 THEN concat(' ', mother_surname2) ELSE '' END, CASE WHEN id % 4 = 1 THEN ' (es su madre)' ELSE ' (Madre)' END) END",
                   "CASE WHEN id % 7 = 0 AND father_given <> '' THEN concat(surname1, ' Otro (padre)') END", "CASE WHEN id % 5 = 0 THEN concat(given, ' ', municipality, ' (padrino)') END", "CASE WHEN id % 6 = 1 THEN 'no consta (testigos)' END", "CASE WHEN id % 11 = 4 THEN 'Petra Dehesa (testigos)' END", "CASE WHEN spouse_given <> '' THEN concat(spouse_given, ' ', spouse_surname, ' (conyuge)') END"], duck)
    return f"""SELECT id, concat('F', CAST(id AS VARCHAR(20))) AS finding, CASE WHEN id % 4 = 3 THEN concat(given, ' ', surname1) ELSE concat(given, ' ', surname1, CASE WHEN surname2 <> '' THEN concat(' ', surname2) ELSE '' END) END AS person,
 CASE WHEN kind = 'bautismo' AND id % 2 = 0 THEN 'Nacimiento' ELSE kind END AS kind, CASE WHEN id % 13 = 5 THEN CAST(year - 40 AS VARCHAR(10)) ELSE fecha END AS fecha, CASE WHEN id % 19 = 3 THEN '' ELSE municipality END AS place, {names} AS names,
 CASE WHEN id % 23 = 1 THEN '' ELSE concat('Acta ', CAST(id AS VARCHAR(20)), ' de ', municipality) END AS quote, concat('https://', CASE id % 4 WHEN 0 THEN 'archivo.example.org' WHEN 1 THEN 'www.familia.example.com' WHEN 2 THEN 'pares.example.net' ELSE 'blog.example.com' END, '/acta/', CAST(id % 500 AS VARCHAR(10))) AS url, id % 29 = 7 AS homonym, CASE WHEN id % 3 = 1 THEN 'aproximada' ELSE 'exacta' END AS precision, CASE WHEN id % 6 = 1 THEN 'edad 30 -> calculado' ELSE '' END AS reason
 FROM {{acts}}"""


def claims(duck: bool) -> str:
    """What a review says of each card: one event an act of the card, one in 31 without a source."""
    return """SELECT a.id AS event, p.id AS person_id, p.name, a.kind, a.fecha, a.municipality AS place, CASE WHEN a.id % 31 = 4 THEN '' ELSE concat('https://archivo.example.org/acta/', CAST(a.id AS VARCHAR(20))) END AS url
 FROM {acts} a JOIN {orders} ON o_orderkey = a.id JOIN {people} p ON p.seq = o_custkey + 1"""


DOMAIN = {"people": people, "acts": acts, "findings": findings, "claims": claims}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"]


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All driver and domain tables, lazily."""

    class Lazy(dict):
        def __missing__(self, name: str) -> DataFrame:
            if name in DOMAIN:
                text = DOMAIN[name](False)
                used = [t for t in (*TABLES, *DOMAIN) if "{" + t + "}" in text]
                self[name] = spark.sql(text.replace("VARCHAR(20)", "STRING").replace("VARCHAR(10)", "STRING").replace("VARCHAR(4)", "STRING").replace("VARCHAR(2)", "STRING"), **{t: self[t] for t in used})
            else:
                self[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            return self[name]

    out = Lazy()
    out.spark, out.sf_dir = spark, sf_dir
    return out


def with_domain(sql: str) -> str:
    """DuckDB SQL with the domain tables that it names put before it."""
    used = [d for d in DOMAIN if f" {d} " in f" {sql.replace('(', ' ').replace(')', ' ').replace(',', ' ').replace(chr(10), ' ')} "]
    for d, needed in (("claims", ("acts", "people")), ("findings", ("acts",))):
        used += [x for x in needed if d in used and x not in used]
    head = ", ".join(f"{d} AS MATERIALIZED ({DOMAIN[d](True).format(**{t: t for t in (*TABLES, *DOMAIN)})})" for d in sorted(used, key=list(DOMAIN).index))
    if not head:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[14:]}"
    return f"WITH {head}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {head} {body}"
