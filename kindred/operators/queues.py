"""The bounded queue of surnames: low-priority newcomers are turned away while it is full."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import running, written

#: Names that wait at most before newcomers of LOW priority (or lower) are turned away.
MOST, LOW = 120, 2


def admit(queue: DataFrame, events: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The queue after events(at, k, priority, source), as events come one by one in the order of at (distinct), and
    the events that were turned away (at, k).

    queue(k, priority, since, waiting, sources): all names ever admitted; a name that is known only betters its priority
    and gathers sources. A newcomer is turned away if `most` names wait and its priority is LOW or worse; it may come
    again. As names only join here, the queue is full from the moment at which the newcomers fill its free places: one
    number, found by counting newcomers over ranges of their first events. Newcomers up to it are in by their first
    event, later ones by their first event of better priority, and what a name sent before that was turned away.
    Null names or priorities are left out; repeated names are one."""
    e = written(events.where("k IS NOT NULL AND k <> '' AND priority IS NOT NULL").select("at", "k", "priority", "source"), "queue-events")
    known = queue.select("k", F.lit(True).alias("known"))
    new = e.join(known.select("k").hint("merge"), "k", "left_anti").groupBy("k").agg(F.min("at").alias("first"), F.min(F.when(F.col("priority") < LOW, F.col("at"))).alias("urgent"))
    new = written(new, "newcomers")
    free = most - queue.where("waiting").count()
    placed = running(new.withColumn("all", F.lit(0)), "all", "first", F.lit(1), "place")
    full = None if free <= 0 else placed.where(F.col("place") == free).select("first").first()  # one number
    if free <= 0:
        joined = F.col("urgent")
    elif full is None:
        joined = F.col("first")
    else:
        joined = F.when(F.col("first") <= full["first"], F.col("first")).otherwise(F.col("urgent"))
    new = written(new.select("k", joined.alias("since")), "joined")
    all_ = e.join(new.hint("merge"), "k", "left")
    # an event of a name of the queue has no row in `new` and always counts
    is_new = e.select("k").distinct().join(known.hint("merge"), "k", "left").where("known IS NULL").select("k", F.lit(True).alias("fresh"))
    all_ = written(all_.join(is_new.hint("merge"), "k", "left").withColumn("away", F.col("fresh").isNotNull() & (F.col("since").isNull() | (F.col("at") < F.col("since")))), "judged")
    heard = all_.where("NOT away").groupBy("k").agg(F.min("priority").alias("p"), F.min("since").alias("s"), F.collect_set("source").alias("more"))
    out = queue.join(heard.hint("merge"), "k", "full_outer").select(
        "k", F.least("priority", "p").alias("priority"), F.coalesce("since", "s").alias("since"), F.coalesce("waiting", F.lit(True)).alias("waiting"),
        F.array_sort(F.array_union(F.coalesce("sources", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>")))).alias("sources"))
    return out, all_.where("away").select("at", "k")


def take(queue: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The queue without its next n names, which wait no longer, and these: the best priority, then the longest waiting."""
    names = queue.where("waiting").orderBy("priority", "since", "k").limit(n)
    names = written(names, "taken")
    out = queue.join(names.select("k", F.lit(True).alias("t")).hint("merge"), "k", "left").withColumn("waiting", F.col("waiting") & F.col("t").isNull()).drop("t")
    return out, names


EMPTY = "k string, priority int, since long, waiting boolean, sources array<string>"
