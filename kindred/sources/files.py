"""Readers and writers of people, fragments, findings and registers."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

EVIDENCE = "struct<tipo:string,fecha:string,lugar:string,fuente_url:string,cita:string,origen:string,verificado:boolean>"
PERSON = (
    "id string, nombre string, apellido_paterno string, apellido_materno string, sexo string, nacimiento struct<fecha_aproximada:string,municipio:string,provincia:string>, "
    f"defuncion struct<fecha_aproximada:string,municipio:string,provincia:string>, padre string, madre string, conyuge string, hijos array<string>, notas string, estado string, evidencias array<{EVIDENCE}>"
)
FRAGMENT = "hash string, persona string, origen string, url string, titulo string, texto_limpio string, texto_original string, fecha_descarga string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def trimmed_keys(schema: S.StructType, df: DataFrame) -> DataFrame:
    """Columns by the schema's names, whatever spaces stand around the keys; a missing one is null."""
    have = {c.strip(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[f.name]}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def load_people(spark: SparkSession, path: str) -> DataFrame:
    """People from JSON files {"personas": [...]}, one row a card; spaces around keys are dropped."""
    raw = spark.read.option("multiLine", True).json(path)
    key = next((c for c in raw.columns if c.strip() == "personas"), None)
    if key is None:
        return spark.createDataFrame([], PERSON)
    return trimmed_keys(S.StructType.fromDDL(PERSON), raw.select(F.explode(f"`{key}`").alias("p")).select("p.*"))


def load_fragments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of JSON lines: what can't be read is set apart, not lost. A missing path is empty."""
    schema = S.StructType([*S.StructType.fromDDL(FRAGMENT), S.StructField("_corrupt_record", S.StringType())])
    if not _exists(spark, path):
        return spark.createDataFrame([], FRAGMENT), spark.createDataFrame([], "_corrupt_record string")
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", schema).alias("x")).select("x.*")
    bad = F.col("_corrupt_record").isNotNull()
    return rows.where(~bad).drop("_corrupt_record"), rows.where(bad).select("_corrupt_record")


def append_fragments(df: DataFrame, path: str) -> None:
    """Append fragments, in a folder for each origin."""
    df.withColumn("origen", F.coalesce(F.nullif(F.trim(F.lower("origen")), F.lit("")), F.lit("web"))).write.mode("append").partitionBy("origen").parquet(path)


def load_or_empty(spark: SparkSession, path: str, schema: S.StructType | str) -> DataFrame:
    """A table of JSON lines, empty where the path is missing; lines that are not JSON are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def append_register(df: DataFrame, path: str) -> None:
    """A register only grows."""
    df.write.mode("append").json(path)


def guarded_overwrite(df: DataFrame, path: str, force: bool = False) -> str | None:
    """Write df as a new version under `path` and return its folder; an empty df never replaces a version
    that has rows, unless forced (then None is returned and nothing changes). Older versions stay."""
    spark = df.sparkSession
    now = current_version(spark, path)
    if not force and df.isEmpty() and now and not spark.read.parquet(now).isEmpty():
        return None
    out = f"{path.rstrip('/')}/v={time.time_ns():020d}"
    df.write.parquet(out)
    return out


def current_version(spark: SparkSession, path: str) -> str | None:
    """The newest version that was written to its end."""
    if not _exists(spark, path):
        return None
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(str(s.getPath()) for s in fs.listStatus(p) if "/v=" in str(s.getPath()))
    return next((n for n in reversed(names) if _exists(spark, n + "/_SUCCESS")), None)


def new_version(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> str:
    """Write several tables as the next version under `path` and return its folder. The mark that makes it current is
    set last, so readers see all of the tables or none."""
    out = f"{path.rstrip('/')}/v={time.time_ns():020d}"
    for name, df in tables.items():
        df.write.parquet(f"{out}/{name}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/_SUCCESS")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True).close()
    return out


def read_version(spark: SparkSession, at: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{at}/{name}") for name, schema in schemas.items()}
