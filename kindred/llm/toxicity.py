"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of its lower-cased characters, hashed to 2**BITS buckets.
With counts p and q of the toxic and other training texts that have a bucket, its ratio is
r = log((p + 1) / (P + 2) / ((q + 1) / (Q + 2))). The score is the logistic function of
b + sum of r * w over a text's features, with w fitted by regularised logistic regression.

Training reads a bounded sample of labelled texts (SAMPLE, half of them toxic at most, chosen by a
hash of the id), so its cost and the model's size are fixed; every text is scored whole."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import release, small_batches

BITS = 18
SIZES = (2, 3, 4, 5)
SAMPLE = 3000
#: A bucket counts if so many training texts have it and its ratio is so far from 0.
LEAST_TEXTS, LEAST_RATIO = 5, 0.25
_U = np.uint32


def features(texts: list[str | None], stamp: np.ndarray) -> Iterator[np.ndarray]:
    """For each text its distinct buckets. stamp: an int32 array of 2**BITS entries for reuse."""
    for t in texts:
        c = np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), _U)
        got, h = [], np.zeros(len(c), _U)
        for n in range(1, SIZES[-1] + 1):
            if n > len(c):
                break
            h = h[: len(c) - n + 1] * _U(0x01000193) ^ c[n - 1 :] * _U(0x9E3779B1)
            if n >= SIZES[0]:
                x = h ^ (h >> _U(15))
                got.append((x * _U(0x2C1B3C6D + 2 * n) >> _U(32 - BITS)).astype(np.int32))
        if not got:
            yield np.empty(0, np.int32)
            continue
        idx = np.concatenate(got)
        turn = np.arange(len(idx), dtype=np.int32)
        stamp[idx] = turn  # of equal buckets the last stays
        yield idx[stamp[idx] == turn]


@dataclass
class Model:
    """weight: r * w of each bucket; square: r * r, for the length of a text's vector."""

    weight: np.ndarray
    square: np.ndarray
    intercept: float

    def score(self, idx: np.ndarray) -> float:
        z = self.intercept + float(self.weight[idx].sum(dtype=np.float64)) / max(1e-6, float(self.square[idx].sum(dtype=np.float64)) ** 0.5)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def to_bytes(self) -> bytes:
        return self.weight.tobytes() + self.square.tobytes() + np.float64(self.intercept).tobytes()

    @staticmethod
    def from_bytes(raw: bytes) -> Model:
        both = np.frombuffer(raw, np.float32, 2 << BITS)
        return Model(both[: 1 << BITS], both[1 << BITS :], float(np.frombuffer(raw[-8:], np.float64)[0]))


def fit(rows: list[tuple[int, np.ndarray]], rate: float = 1.0, ridge: float = 1e-5, steps: int = 80) -> Model:
    """Of (label, buckets) of the training texts, a list that is used up. Without both labels the weights are 0 and the
    intercept says the one label there is (0 without rows)."""
    size = 1 << BITS
    y = np.array([label for label, _ in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0 if not len(y) else (4.0 if y[0] else -4.0))
    counts = np.zeros((2, size))
    for label, idx in rows:
        counts[label][idx] += 1
    q, p = counts
    r = np.log((p + 1) / (y.sum() + 2)) - np.log((q + 1) / (len(y) - y.sum() + 2))
    r[(p + q < LEAST_TEXTS) | (abs(r) < LEAST_RATIO)] = 0
    live = np.flatnonzero(r)
    to = np.full(size, -1, np.int32)
    to[live] = np.arange(len(live), dtype=np.int32)
    sizes = []
    for k, (label, idx) in enumerate(rows):  # in place, so that the whole is held once
        c = to[idx]
        rows[k] = (label, c[c >= 0])
        sizes.append(len(rows[k][1]))
    col = np.concatenate([c for _, c in rows])
    rows.clear()
    row = np.repeat(np.arange(len(y), dtype=np.int32), sizes)
    # a text's vector has length 1: long texts weigh no more than short ones
    x = r[live].astype(np.float32)[col]
    norm = np.sqrt(np.maximum(np.bincount(row, x * x, len(y)), 1e-12)).astype(np.float32)
    x /= norm[row]
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w, b, gw, gb = np.zeros(len(live), np.float32), 0.0, np.full(len(live), 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(row, w[col] * x, len(y)) + b
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        g, h = np.bincount(col, e.astype(np.float32)[row] * x, len(live)) + ridge * w, e.sum()
        gw, gb = gw + g * g, gb + h * h
        w, b = (w - rate * g / np.sqrt(gw)).astype(np.float32), b - rate * h / np.sqrt(gb)
    weight, square = np.zeros(size, np.float32), np.zeros(size, np.float32)
    weight[live], square[live] = w * r[live], r[live] ** 2
    return Model(weight, square, float(b))


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether the row is in the fold whose labels are never learnt from (null ids are not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labelled texts outside the held-out fold. Labels other than 0 and 1, null ids and
    ids with both labels are left out; of repeated documents each counts. The sample, at most `sample`
    ids, is broadcast to the documents; its features meet in one task, which fits the model."""
    spark = docs.sparkSession
    small_batches(spark)
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("toxic").cast("int").alias("label"), F.max("toxic").alias("other")).where("label = other").drop("other"))
    some = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for k in (1, 0)]
    chosen = docs.select("doc_id", "text").join(F.broadcast(some[0].unionByName(some[1])), "doc_id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stamp = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            if batch.num_rows:
                got = [x.tobytes() for x in features(batch.column(1).to_pylist(), stamp)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], names=["label", "buckets"])
        release()

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, np.ndarray]] = []
        for batch in batches:
            rows += [(k, np.frombuffer(x, np.int32)) for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([fit(rows).to_bytes()], pa.binary())], names=["model"])
        release()

    rows = chosen.select("label", "text").mapInArrow(featured, "label int, buckets binary")
    return Model.from_bytes(bytes(rows.repartition(1).mapInArrow(fitted, "model binary").collect()[0].model))


def score(df: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """df with the column `to`, 0 to 1. Empty and null texts get the intercept's score; all rows and
    other columns are kept (one named `to` is replaced). No shuffle."""
    spark = df.sparkSession
    small_batches(spark)
    rest = df.drop(to)
    shared = spark.sparkContext.broadcast(model.to_bytes())
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), f"`{to}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, stamp = Model.from_bytes(shared.value), np.zeros(1 << BITS, np.int32)
        for batch in batches:
            got = [m.score(x) for x in features(batch.column(batch.schema.get_field_index(text)).to_pylist(), stamp)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, to])
        release()

    return rest.mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    got = score(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
