"""What the operators of this subpackage share: the folder that driver and executors both see,
written tables that cut lineage, and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch of texts: whichever is met first ends it; a longer text is one by itself.
TEXT_BATCH_ROWS, TEXT_BATCH_BYTES = 1000, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only where it is unset and all runs on one machine (tests)
    a temporary one is made and set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own for each call, so that runs never meet."""
    return f"{shared_dir(spark)}/kindred-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, state: Observation | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: a lost executor costs a re-read of
    files, not the lineage, and the sizes that the planner sees are real. state: gets the count and two
    sums that tell apart tables of (a, b), as `state`."""
    spark = df.sparkSession
    if state is not None:
        df = df.observe(state, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1000003).alias("x"), F.sum(F.xxhash64("b", "a") % 999983).alias("y"))
    path = new_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kindred_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """As stored(), but in n buckets of key: joins on key with tables repartitioned into n move no row of it."""
    path = new_dir(df.sparkSession, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(table)
    out = df.sparkSession.table(table)
    out._kindred_path, out._kindred_table = path, table
    return out


def new_name(df: DataFrame, name: str) -> str:
    """name, made longer until no column of df has it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def drop_stored(df: DataFrame) -> None:
    """Delete a table that stored() or bucketed() wrote and that no later plan reads."""
    path, table = getattr(df, "_kindred_path", None), getattr(df, "_kindred_table", None)
    if table:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean_shuffles(spark: SparkSession) -> None:
    """Collect the driver's garbage, so that Spark deletes the shuffle files of plans that nothing refers to any
    more; otherwise they stay on the executors' disks until the driver's memory happens to fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Keep Arrow batches of texts at a few MB in this session's Python stages, in rows and in bytes. Plans run
    after the function that made them returned, so the setting stays; it changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH_BYTES))


def release() -> None:
    """At a task's end: give memory that Python freed back, as the worker process stays for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(a, b) links between long ids -> (id, component_id), one row per id that has a link to another,
    component_id the smallest id reachable.

    Large-star and small-star rounds on tables: each round takes the smallest neighbour by a combinable
    min, writes it and joins it back; with both sides written, adaptive execution can split the join where
    a hub is hot. Rounds grow with the logarithm of the longest path; more than max_rounds raise. Null ends
    and loops are left out; repeated links count once; an empty table gives an empty one."""
    now = stored(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
                 .where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    for _ in range(max_rounds):
        # large star: the larger neighbours of u get u's smallest neighbour (or u)
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-low")
        large = now.join(low.select(F.col("u").alias("b"), "m").hint("merge"), "b").select("a", F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), f"{name}-large")
        # small star: u's smaller neighbours and u get the smallest of them
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least")
        small = large.join(least.hint("merge"), "a")
        nxt = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        state = Observation()
        nxt = stored(nxt, name, state)
        for t in (now, low, large, least):
            drop_stored(t)
        now = nxt
        if state.get == seen:
            break
        seen = state.get
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    ends = now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component_id"))
    return ends.union(now.select("b", "b").distinct())
