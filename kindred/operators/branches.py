"""Who belongs to a branch of the family: its places, then its ancestors, then those of its surnames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import text as T

from .matching import surname_pairs
from .register import plain_surname
from .tables import written


def in_branch(province: Column | str, place: Column | str, provinces: list[str], prefixes: list[str]) -> Column:
    """Whether the province is one of the branch's or the municipality begins like one of its own."""
    p, m = T.norm(province), T.norm(place)
    near = F.lit(False)
    for x in prefixes:
        near = near | F.startswith(m, T.norm(F.lit(x)))
    return p.isin([x.lower() for x in provinces]) | near


def closure(people: DataFrame, queue: DataFrame, provinces: list[str], prefixes: list[str], by_surname: bool = True, hops: int = 4, rounds: int = 3) -> DataFrame:
    """k (normalised name), how (`place`, `queue`, `ancestor`, `surname`), round of the members of a branch.

    people(seq, name, surname1, province, place, father, mother); queue(name, province, place) of searches that wait.
    Members are told by name; of several cards the smallest seq speaks for the name. A card that states another
    province or place is of another branch and never joins by the two rules: parents (by equal name) of members, up to
    `hops` steps, and, in a round in which nobody's parents joined, cards whose surname is the same as a usable paternal
    surname of a member. At most `rounds` rounds; it ends earlier when neither rule adds anybody. Cards without a name
    are left out; a name that is in the queue alone is a member without parents."""
    inside = in_branch("province", "place", provinces, prefixes)
    stated = (F.coalesce("province", F.lit("")) != "") | (F.coalesce("place", F.lit("")) != "")
    p = people.select("seq", T.norm("name").alias("k"), plain_surname("surname1").alias("s"), T.usable_surname("surname1").alias("usable"), T.norm("father").alias("father"), T.norm("mother").alias("mother"), inside.alias("inside"), (stated & ~inside).alias("other")).where("k <> ''")
    p = written(p, "branch-cards")
    card = written(p.groupBy("k").agg(F.min(F.struct("seq", "s", "usable", "father", "mother", "other")).alias("m")).select("k", "m.*"), "names")
    first = p.where("inside").select("k").distinct().select("k", F.lit("place").alias("how"))
    waits = queue.where(inside).select(T.norm("name").alias("k")).where("k <> ''").distinct().select("k", F.lit("queue").alias("how"))
    members = written(first.unionByName(waits).groupBy("k").agg(F.min("how").alias("how")).select("k", "how", F.lit(0).alias("round")), "members")
    # the surname of a member is that of the card which joined: the branch's own card if it has one
    parents = written(card.select("k", F.explode(F.array("father", "mother")).alias("up")).where("up <> ''").join(card.where("NOT other").select(F.col("k").alias("up")).hint("merge"), "up").select("k", "up"), "parents")
    surnames = written(p.where("usable AND s <> ''").select("k", "s", "inside", "other", "seq"), "usable")
    pairs = written(surname_pairs(surnames.select("s"), p.where("s <> ''").select("s")), "surnames") if by_surname else None
    for turn in range(1, rounds + 1):
        new, fresh = members.select("k"), 0
        for _ in range(hops):
            new = written(parents.join(new.hint("merge"), "k").select(F.col("up").alias("k")).distinct().join(members.select("k").hint("merge"), "k", "left_anti"), "ancestors")
            if new.isEmpty():
                break
            fresh = 1
            members = written(members.unionByName(new.select("k", F.lit("ancestor").alias("how"), F.lit(turn).alias("round"))), "members")
        if fresh:
            continue
        if not by_surname:
            break
        own = surnames.join(members.select("k").hint("merge"), "k").groupBy("k").agg(F.min(F.struct((~F.col("inside")).alias("o"), "other", "seq", "s")).alias("m")).select("m.s").distinct()
        same = pairs.join(own.hint("merge"), "s").select(F.col("t").alias("s")).distinct()
        new = p.where("NOT other").join(same.hint("merge"), "s").select("k").distinct().join(members.select("k").hint("merge"), "k", "left_anti")
        new = written(new, "of-surname")
        if new.isEmpty():
            break
        members = written(members.unionByName(new.select("k", F.lit("surname").alias("how"), F.lit(turn).alias("round"))), "members")
    return members
