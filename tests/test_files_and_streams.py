import datetime
import json

from pyspark.sql import functions as F

from kindred.sources import files as S
from kindred.streaming import jobs as J


def test_people_and_fragments(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"personas": [{" nombre ": "Ana Dehesa", "hijos": ["B"]}, {" nombre ": "Blas Dehesa", "hijos": []}]}))
    got = S.load_people(spark, str(tmp_path / "p.json"))
    assert got.columns[1] == "nombre" and {r.nombre for r in got.collect()} == {"Ana Dehesa", "Blas Dehesa"}
    (tmp_path / "f.json").write_text('{"hash": "a", "origen": " WEB "}\n{broken\n{"hash": "b"}\n')
    good, bad = S.load_fragments(spark, str(tmp_path / "f.json"))
    assert good.count() == 2 and bad.count() == 1
    S.append_fragments(good, str(tmp_path / "corpus"))
    S.append_fragments(good, str(tmp_path / "corpus"))
    assert spark.read.parquet(str(tmp_path / "corpus")).groupBy("origen").count().collect()[0]["count"] == 4
    assert S.load_fragments(spark, str(tmp_path / "none"))[0].count() == 0
    assert S.load_or_empty(spark, str(tmp_path / "none"), S.FRAGMENT).count() == 0


def test_guarded_overwrite(spark, tmp_path):
    at, df = str(tmp_path / "t"), spark.range(3)
    first = S.guarded_overwrite(df, at)
    assert S.guarded_overwrite(df.where("false"), at) is None and S.current_version(spark, at).endswith(first.rpartition("/")[2])
    assert S.guarded_overwrite(df.where("false"), at, force=True) and spark.read.parquet(S.current_version(spark, at)).count() == 0
    assert spark.read.parquet(first).count() == 3
    S.append_register(df, str(tmp_path / "r"))
    S.append_register(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 6


def run(df, mode, name, spark):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streams(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    hour = datetime.timedelta(hours=1)
    rows = [("q1", t0, "fail"), ("q1", t0 + hour, "outage"), ("q1", t0 + 5 * hour, "fail"), ("q1", t0 + 7 * hour, "ok"), ("q1", t0 + 12 * hour, "fail"), ("q2", t0, "ok"), ("q2", t0 + 9 * hour, "ok")]
    src = str(tmp_path / "s")
    spark.createDataFrame(rows, "query string, ts timestamp, outcome string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("query string, ts timestamp, outcome string").parquet(src)
    got = {(r.query, r.ts): r.allowed for r in run(J.cooldown(stream), "append", "cool", spark).collect()}
    assert got == {("q1", t0): True, ("q1", t0 + hour): False, ("q1", t0 + 5 * hour): False, ("q1", t0 + 7 * hour): False, ("q1", t0 + 12 * hour): False, ("q2", t0): True, ("q2", t0 + 9 * hour): False}
    reg = stream.select(F.col("query").alias("anchor"), "ts", F.col("outcome").alias("reason"))
    assert {(r.anchor, r.attempts, r.reason) for r in run(J.negative_summary(reg), "complete", "neg", spark).collect()} == {("q1", 5, "fail"), ("q2", 2, "ok")}
    frag = stream.select(F.col("outcome").alias("hash"), "ts")
    assert run(J.new_documents(frag), "append", "docs", spark).count() == 3
    batch = spark.read.parquet(src).select(F.col("outcome").alias("hash"), "ts")
    for _ in range(2):
        J.ingest_once(batch, str(tmp_path / "once"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 3


def test_ingest_by_batches(spark, tmp_path):
    """Batches by id: one run again replaces its own rows, and a batch reads only the folders of its hashes."""
    at, t0 = str(tmp_path / "seen"), datetime.datetime(2024, 1, 1)
    make = lambda hashes: spark.createDataFrame([(h, t0, 1) for h in hashes], "hash string, ts timestamp, part_ int")
    have = lambda: sorted((r.hash, r.batch) for r in spark.read.parquet(at).collect())
    J.ingest_once(make(["a", "b", "a", None]), at, 0)
    J.ingest_once(make(["b", "c"]), at, 1)
    want = [("a", 0), ("b", 0), ("c", 1)]
    assert have() == want
    J.ingest_once(make(["b", "c"]), at, 1)
    J.ingest_once(make(["a", "b"]), at, 0)
    assert have() == want
    J.ingest_once(make([]), at, 2)
    assert have() == want
    plan = spark.read.parquet(at).where(F.col("part").isin([3]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_cooldown_in_batches_is_the_replay(spark, tmp_path):
    """A file a batch, so that state is kept and dropped between batches; the same answers as one walk over all rows."""
    import random

    r, t0, src = random.Random(4), datetime.datetime(2024, 1, 1), str(tmp_path / "s")
    rows = sorted((t0 + datetime.timedelta(minutes=13 * i), f"q{r.randrange(5)}", r.choice(["fail", "fail", "outage", "outage", "ok" if i > 150 else "fail"])) for i in range(200))
    done, last, want = set(), {}, {}
    for ts, q, outcome in rows:
        want[q, ts] = q not in done and (q not in last or ts >= last[q] + datetime.timedelta(hours=2))
        if outcome == "ok":
            done.add(q)
        if outcome == "fail":
            last[q] = ts
    for k in range(4):
        spark.createDataFrame([(q, ts, o) for ts, q, o in rows[50 * k : 50 * k + 50]], "query string, ts timestamp, outcome string").coalesce(1).write.mode("append").parquet(f"{src}/{k}")
    stream = spark.readStream.schema("query string, ts timestamp, outcome string").option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = J.cooldown(stream, 2.0, "0 seconds").writeStream.outputMode("append").format("memory").queryName("replay").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in (x if isinstance(x, dict) else __import__("json").loads(x.json) for x in q.recentProgress) if p["stateOperators"]]
    finally:
        q.stop()
    assert {(x.query, x.ts): x.allowed for x in spark.table("replay").collect()} == want and True in want.values() and False in want.values()
    assert max(kept) <= 40
