"""Queries by name, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kindred.sources.adapters import tables, with_domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register f(tables) -> DataFrame under a name; sql: DuckDB SQL for the same rows."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(tables(spark, sf_dir))
        if sql:
            SQL[name] = with_domain(sql)
        return f

    return put


def strings(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def norm(x: str) -> str:
    """SQL of functions.text.norm."""
    return f"trim(regexp_replace(strip_accents(lower(coalesce({x}, ''))), '\\s+', ' ', 'g'))"


def tokens(x: str) -> str:
    from kindred.functions.text import STOPWORDS

    return f"list_distinct(list_filter(string_split({norm(x)}, ' '), lambda t: len(t) > 2 AND NOT list_contains({strings(STOPWORDS)}, t)))"


def year_of(x: str, floor: int = 1400) -> str:
    return f"TRY_CAST(nullif(regexp_extract(coalesce({x}, ''), '(1[{'4' if floor == 1400 else '5'}-9]\\d\\d|20\\d\\d)', 1), '') AS INTEGER)"


def event_class(x: str) -> str:
    n = norm(x)
    return f"""CASE WHEN {n} IN ('nacimiento', 'nacer', 'bautismo', 'bautizo', 'bautismos') THEN 'birth' WHEN {n} IN ('defuncion', 'fallecimiento', 'entierro', 'difunto', 'muerte') THEN 'death' WHEN regexp_matches({n}, 'matrimonio|boda|casamiento') THEN 'marriage' ELSE {n} END"""


def given_key(x: str) -> str:
    s = f"replace(replace(replace({norm(x)}, 'v', 'b'), 'y', 'i'), 'h', '')"
    return f"array_to_string(list_filter(string_split({s}, ''), lambda c, i: i = 1 OR c <> string_split({s}, '')[i - 1]), '')"


def same_surname(a: str, b: str) -> str:
    x, y = f"replace({norm(a)}, '-', ' ')", f"replace({norm(b)}, '-', ' ')"
    return f"({x} <> '' AND {y} <> '' AND ({x} = {y} OR (len({x}) >= 4 AND len({y}) >= 4 AND (contains({x}, {y}) OR contains({y}, {x})))))"
