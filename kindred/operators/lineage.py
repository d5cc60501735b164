"""Walks over parents and kin: generation depths and the growth of a family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import text as T

from .tables import written


def generations(edges: DataFrame, roots: DataFrame | list, most: int = 40) -> DataFrame:
    """id, depth (the least) over edges(child, parent) from the roots (a list, or a table of id), a round a generation."""
    spark = edges.sparkSession
    start = roots if isinstance(roots, DataFrame) else spark.createDataFrame([(r,) for r in roots], "id long")
    seen = written(start.distinct().withColumn("depth", F.lit(0)), "depth")
    edges = written(edges.select("child", "parent").distinct(), "edges")
    for k in range(1, most + 1):
        last = seen.where(F.col("depth") == k - 1).select(F.col("id").alias("child"))
        new = edges.join(last.hint("merge"), "child").select(F.col("parent").alias("id")).distinct().join(seen.select("id").hint("merge"), "id", "left_anti").withColumn("depth", F.lit(k))
        new = written(new, "depth")
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
    return seen  # as deep as was asked for


def kin_expansion(seeds: DataFrame, acts: DataFrame, most: int = 60) -> DataFrame:
    """(g, s): given-name keys and surnames of the kin of seeds(given, surname1). A round looks up the baptisms
    whose father is one of the kin that the last round added, which certifies them, and adds the child and both
    parents; names are merged by key. It ends when nobody is added; more than `most` rounds raise."""
    part = lambda g, s: F.struct(T.given_key(g).alias("g"), T.norm(s).alias("s"))
    a = acts.where("kind = 'bautismo'").select(part("father_given", "father_surname").alias("f"), F.array(part("given", "surname1"), part("father_given", "father_surname"), part("mother_given", "mother_surname")).alias("who"))
    # families of the same names say the same, so each is looked up once
    a = written(a.select("f.*", F.explode("who").alias("w")).select(F.col("g").alias("fg"), F.col("s").alias("fs"), "w.*").where("fg <> '' AND g <> ''").distinct(), "certified")
    new = written(seeds.select(part("given", "surname1").alias("x")).select("x.*").where("g <> ''").distinct(), "kin")
    kin = new
    for _ in range(most):
        met = new.select(F.col("g").alias("fg"), F.col("s").alias("fs")).join(a.hint("merge"), ["fg", "fs"]).select("g", "s").distinct()
        new = written(met.join(kin.hint("merge"), ["g", "s"], "left_anti"), "kin")
        if new.isEmpty():
            return kin
        kin = kin.unionByName(new)
    raise RuntimeError(f"the kin still grow after {most} rounds")
