"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Only where the setting is missing and all runs on one machine
    (tests) a temporary folder is made and set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/kindred-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: rounds of a loop and results that are used several times neither grow the
    plan nor depend on an executor that may be lost."""
    spark: SparkSession = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a side that is broadcast once they have been counted.
SIDE_ROWS = 200_000


def side(df: DataFrame, name: str) -> DataFrame:
    """df written and, if its rows are few, to be broadcast: joins to it need not shuffle the other side."""
    out = written(df, name)
    return out.hint("broadcast" if out.count() <= SIDE_ROWS else "merge")


def running(df, key, order, value, name):
    """df with the running sum `name` of value by key: ranges of the order are summed apart and then shifted by the
    sums of the ranges before, so that no task gets all rows of a key. Written, as ranges are drawn by sampling."""
    part = written(df.repartitionByRange(key, order).withColumn("part", F.spark_partition_id()), "ranges")
    sums = part.groupBy(key, "part").agg(F.sum(value).alias("n"))
    before = sums.select(key, "part", F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    w = Window.partitionBy(key, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return part.join(before.hint("merge"), [key, "part"]).withColumn(name, F.sum(value).over(w) + F.col("before")).drop("part", "before")
