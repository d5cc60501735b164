"""Queries that run as streams over a table and give what they wrote (rows J of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.operators.tables import shared_path
from kindred.streaming.jobs import cooldown, ingest_once

from .registry import query


def events(t):
    """The events as they come. The path is a pattern, as a stream takes a plain one for a folder and the table may be a file."""
    e = t.spark.readStream.schema(t["events"].schema).parquet(f"{t.sf_dir}/events.parque[t]")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream) -> None:
    """Run a started stream over all that is there."""
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()


@query("j1_ingest_stream", "SELECT props AS hash, CAST(min(ts) AS TIMESTAMP) AS ts FROM events WHERE props IS NOT NULL GROUP BY props")
def j1(t):
    """The first event of each payload, taken in by two runs of a stream; the second, which starts over, adds nothing."""
    to = shared_path(t.spark, "seen")
    rows = events(t).select(F.col("props").alias("hash"), "ts", "event_id")
    for run in range(2):
        put = lambda batch, i: ingest_once(batch, to, i, parts=32)
        finished(rows.writeStream.foreachBatch(put).option("checkpointLocation", shared_path(t.spark, "check")).trigger(availableNow=True).start())
    return t.spark.read.parquet(to).select("hash", "ts")


@query("j2_cooldown_stream", "SELECT CAST(user_id AS VARCHAR) AS query, CAST(ts AS TIMESTAMP) AS ts, coalesce(ts >= last_fail + INTERVAL 6 HOUR, true) AND NOT coalesce(done, false) AS allowed FROM (SELECT user_id, ts, max(CASE WHEN event_type = 'error' THEN ts END) OVER w AS last_fail, bool_or(event_type = 'purchase') OVER w AS done FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
def j2(t):
    """Whether each search was allowed, from the stateful stream: the same as over the whole table at once."""
    to = shared_path(t.spark, "allowed")
    outcome = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "ok").otherwise("outage")
    rows = cooldown(events(t).select(F.col("user_id").cast("string").alias("query"), "ts", outcome.alias("outcome")))
    finished(rows.writeStream.outputMode("append").format("parquet").option("path", to).option("checkpointLocation", shared_path(t.spark, "check")).trigger(availableNow=True).start())
    return t.spark.read.schema("query string, ts timestamp, allowed boolean").parquet(to)
