"""Incremental forms on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Folders that the seen hashes are dealt to.
PARTS = 256
STORE = "spark.sql.streaming.stateStore.providerClass"


def new_documents(fragments: DataFrame, time: str = "ts", delay: str = "7 days") -> DataFrame:
    """Fragments whose hash has not come within the watermark; state is bounded by it."""
    return fragments.withWatermark(time, delay).dropDuplicatesWithinWatermark(["hash"])


def seen_part(hash_: str = "hash", parts: int = PARTS):
    return F.pmod(F.xxhash64(hash_), F.lit(parts)).cast("int")


def ingest_once(batch: DataFrame, path: str, batch_id: int | None = None, parts: int = PARTS) -> None:
    """For foreachBatch: append the rows whose hash the table at `path` does not hold, across all runs; of a hash's rows
    the earliest. The table is kept in `parts` folders by hash, and a batch reads only the folders of its own hashes.

    A batch that is run again adds nothing: rows that it added before are known, and with a batch_id it also replaces
    its own earlier files, so that an attempt that was cut off leaves nothing behind. Null hashes are left out."""
    spark = batch.sparkSession
    first = batch.where("hash IS NOT NULL").groupBy("hash").agg(F.min_by(F.struct(*batch.columns), "ts").alias("x")).select("x.*").withColumn("part", seen_part(parts=parts))
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        mine = [r.part for r in first.select("part").distinct().collect()]  # `parts` numbers at most
        seen = spark.read.parquet(path).where(F.col("part").isin(mine))
        if batch_id is not None:
            seen = seen.where(F.col("batch") != batch_id)
        first = first.join(seen.select("hash", "part").hint("merge"), ["part", "hash"], "left_anti")
    out = first.select(*batch.columns, F.lit(-1 if batch_id is None else batch_id).cast("long").alias("batch"), "part")
    how = out.write.partitionBy("batch", "part")
    if batch_id is None:
        how.mode("append").parquet(path)
    else:
        how.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def negative_summary(register: DataFrame) -> DataFrame:
    """Attempts, last time and last reason of each anchor, updated as the register grows."""
    return register.where("anchor IS NOT NULL").groupBy("anchor").agg(F.count("*").alias("attempts"), F.max("ts").alias("last"), F.max_by("reason", "ts").alias("reason"))


class _Cooldown(StatefulProcessor):
    """State of a query: whether it succeeded, and its last failure while that still counts."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "done boolean")
        self.last = handle.getValueState("last", "last double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values("ts", kind="stable")
        done, before = self.done.exists(), self.last.get()[0] if self.last.exists() else None
        last, out = before, []
        for ts, outcome in zip(every["ts"], every["outcome"], strict=True):
            now = ts.timestamp()
            out.append((key[0], ts, not done and (last is None or now >= last + self.seconds)))
            done, last = done or outcome == "ok", now if outcome == "fail" else last
        if done and not self.done.exists():
            self.done.update((True,))
        if last != before and not done:
            if before is not None:
                self.handle.deleteTimer(self._rests_until(before))
            self.last.update((float(last),))
            self.handle.registerTimer(self._rests_until(last))
        if done and self.last.exists():
            self.handle.deleteTimer(self._rests_until(before))
            self.last.clear()
        yield pd.DataFrame(out, columns=["query", "ts", "allowed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def _rests_until(self, last: float) -> int:
        return int((last + self.seconds) * 1000) + 1

    def close(self) -> None:
        pass


def cooldown(searches: DataFrame, hours: float = 6.0, delay: str = "1 hour") -> DataFrame:
    """searches(query, ts, outcome) -> query, ts, allowed: a failed query rests for so many hours after its last
    failure, a success is permanent, an outage changes nothing. Rows later than `delay` are dropped.

    State is a mark for each query that succeeded, and one number for each whose last failure still counts: a timer of
    event time removes it when the watermark has passed its rest. The state store must be RocksDB (set here)."""
    spark: SparkSession = searches.sparkSession
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return (searches.select("query", "ts", "outcome").withWatermark("ts", delay).groupBy("query")
            .transformWithStateInPandas(_Cooldown(hours * 3600), "query string, ts timestamp, allowed boolean", "Append", "EventTime"))
