"""A training-data pipeline over `documents`: toxicity, near-duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last
return the columns of documents; what a stage decides is in the rows and texts that it returns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import byte_bpe, decontaminate, near_docs, secrets, toxicity
from kindred.llm._common import new_name, stored

#: No SQL for the classifier and the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs less the rows of these ids; the texts are shuffled only if the ids are too many to broadcast."""
    ids = stored(ids.where(F.col("doc_id").isNotNull()).select("doc_id").distinct(), "removed")
    return docs.join(ids.hint("broadcast" if ids.count() <= near_docs.BROADCAST_ROWS else "merge"), "doc_id", "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels, rejects go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    to = new_name(docs, "_toxic")
    return toxicity.score(docs, model, to=to).where(F.col(to) < 0.5).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, a similarity of 0.8) the smallest id stays."""
    return _without(docs, near_docs.near_documents(docs, shingle=5, percent=80).where(~F.col("kept")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of 10 words of a benchmark item occurs go."""
    return _without(docs, decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific credentials are replaced in the text; n_chars follows."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        df = stage(spark, df, sf_dir)
        if k + 1 < len(STAGES):
            df = stored(df, name)
    return df
