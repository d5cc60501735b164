"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is lower-cased; its words are the runs of letters. Its features are each word and the 2- to 4-grams of each
word with its bounds, hashed to 2**BITS buckets, with repetition. The mean of the buckets' embeddings goes through
a linear layer and a softmax. Embeddings and layer are learnt together by stochastic gradient descent, a text a
step, on a bounded sample (`sample` texts of each language, chosen by hash; at most `most` languages, the most
frequent first).

Calibration: one sampled text in CALIBRATION is kept from the descent, whole and as its first words alone. A
temperature is fitted to their log-loss, and the rejection threshold is the smallest probability from which on
`precision` of them are right. `score()` says which texts are under it; its prediction stays the likeliest language."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import new_name, release, small_batches

BITS, WIDTH, GRAMS = 16, 16, (2, 3, 4)
#: Texts of a language that are learnt from, and languages, at most. No language has more than 1,000: Spark then keeps
#: the first rows of a window before the shuffle.
SAMPLE, MOST = 500, 200
EPOCHS, RATE, CALIBRATION = 6, 0.5, 5
#: Characters of a text that are handled at a time, ended at the next word.
SLICE = 1 << 20
_U = np.uint32
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter; made once a process."""
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTER[0]


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(15))) * _U(0x2C1B3C6D)
    h = (h ^ (h >> _U(12))) * _U(0x297A2D39)
    return (h >> _U(32 - BITS)).astype(np.int32)


def features(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of a text, a slice at a time; nothing if it has no letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), _U)
    lo = 0
    while lo < len(c):
        hi = lo + SLICE
        if hi < len(c):
            gap = np.flatnonzero(~letters()[c[hi : hi + SLICE]])
            hi = hi + int(gap[0]) if len(gap) else len(c)
        got = _features(c[lo:hi])
        if len(got):
            yield got
        lo = hi


def _features(c: np.ndarray) -> np.ndarray:
    inside = letters()[c]
    keep = inside | np.concatenate([[True], inside[:-1]])  # of a gap, its first character
    x = np.where(inside, c, 0)[keep]
    if len(x) and x[0]:
        x = np.concatenate([[0], x])
    x = np.concatenate([x, [0]]).astype(_U)  # bounds are zeros
    bound = np.flatnonzero(x == 0)
    start, end = bound[:-1] + 1, bound[1:]
    start, end = start[end > start], end[end > start]
    if not len(start):
        return np.empty(0, np.int32)
    # whole words: sums of their letters' products with powers of the place
    out, h = [], np.zeros(len(x), _U)
    word = np.add.reduceat((x * _U(0x9E3779B1) ^ (x >> _U(3))) * _U(0x85EBCA77) ** (np.arange(len(x)) - np.repeat(bound, np.diff(np.append(bound, len(x))))).astype(_U), start, dtype=_U)
    out.append(_spread(word ^ _U(0xA511E9B3)))
    zero = x == 0
    for n in range(1, GRAMS[-1] + 1):
        if n > len(x):
            break
        h = h[: len(x) - n + 1] * _U(0x01000193) ^ x[n - 1 :] * _U(0x9E3779B1)
        if n >= GRAMS[0]:
            # no bound but at the ends, and a letter at least
            ok = np.ones(len(h), bool)
            for j in range(1, n - 1):
                ok &= ~zero[j : len(x) - n + 1 + j]
            if n == 2:
                ok &= ~(zero[: len(h)] & zero[1:])
            out.append(_spread(h[ok] + _U(n)))
    return np.concatenate(out)


@dataclass
class Model:
    """langs: in the order of the layer's columns. temperature divides the layer's output; below threshold a prediction is rejected."""

    langs: list[str]
    embedding: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def mean(self, text: str | None) -> np.ndarray | None:
        total, n = np.zeros(WIDTH), 0
        for idx in features(text):
            total += self.embedding[idx].sum(0, dtype=np.float64)
            n += len(idx)
        return total / n if n else None

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        z = (mean @ self.layer + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, probability, rejected; `und`, 0 and True if nothing was learnt or the text has no letter."""
        mean = self.mean(text) if self.langs else None
        if mean is None:
            return "und", 0.0, True
        p = self.probabilities(mean)
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] < self.threshold)

    def to_bytes(self) -> bytes:
        head = json.dumps([self.langs, self.temperature, self.threshold]).encode()
        return np.int64(len(head)).tobytes() + head + self.embedding.astype(np.float32).tobytes() + self.layer.tobytes() + self.bias.tobytes()

    @staticmethod
    def from_bytes(raw: bytes) -> Model:
        n = int(np.frombuffer(raw[:8], np.int64)[0])
        langs, temperature, threshold = json.loads(raw[8 : 8 + n])
        at, size = 8 + n, WIDTH << BITS
        embedding = np.frombuffer(raw, np.float32, size, at).reshape(-1, WIDTH)
        rest = np.frombuffer(raw[at + 4 * size :], np.float64)
        return Model(langs, embedding, rest[: WIDTH * len(langs)].reshape(WIDTH, -1), rest[WIDTH * len(langs) :], temperature, threshold)


def beginning(text: str, words: int = 8) -> str:
    """The first words alone, so that calibration sees short texts too."""
    return " ".join(text.split(None, words)[:words])


def gradients(mean: np.ndarray, layer: np.ndarray, bias: np.ndarray, k: int, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Of the weighted loss -log p[k]: by the layer's output (and so the bias), and by the mean."""
    z = mean @ layer + bias
    p = np.exp(z - z.max())
    p /= p.sum()
    p[k] -= 1
    p *= weight
    return p, layer @ p


def fit(rows: list[tuple[str, str | None]], precision: float = 0.99, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Of (language, text), in this order apart from a fixed shuffle of each epoch. Texts without a letter teach nothing."""
    langs = sorted({lang for lang, _ in rows})
    rng = np.random.default_rng(7)
    model = Model(langs, rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32), np.zeros((WIDTH, len(langs))), np.zeros(len(langs)))
    if not langs:
        return model
    number = {lang: k for k, lang in enumerate(langs)}
    keep = [i % CALIBRATION == CALIBRATION - 1 for i in range(len(rows))]
    seen: list[tuple[int, np.ndarray, np.ndarray]] = []
    for (lang, text), held in zip(rows, keep, strict=True):
        if not held and (got := list(features(text))):
            idx, count = np.unique(np.concatenate(got), return_counts=True)
            seen.append((number[lang], idx, (count / count.sum()).astype(np.float32)))
    # languages weigh the same, however many texts they have
    share = np.bincount([k for k, _, _ in seen], minlength=len(langs))
    weight = np.where(share > 0, len(seen) / np.maximum(share, 1) / max(1, (share > 0).sum()), 0)
    e, w, b, steps = model.embedding, model.layer, model.bias, 0
    for _ in range(epochs):
        for j in rng.permutation(len(seen)):
            k, idx, part = seen[j]
            step = rate * (1 - steps / (epochs * len(seen)))
            mean = part @ e[idx]
            p, back = gradients(mean, w, b, k, min(weight[k], 10.0))
            w -= step * np.outer(mean, p)
            b -= step * p
            # a bucket moves by its share of the features, scaled so that the text's mean moves by the step
            e[idx] -= (step / (part @ part) * part)[:, None].astype(np.float32) * back.astype(np.float32)
            steps += 1
    _calibrate(model, [(number[lang], t) for (lang, text), held in zip(rows, keep, strict=True) if held and text for t in (text, beginning(text))], precision)
    return model


def _calibrate(model: Model, rows: list[tuple[int, str]], precision: float) -> None:
    both = [(k, m) for k, t in rows if (m := model.mean(t)) is not None]
    if not both:
        return
    truth = np.array([k for k, _ in both])
    z = np.array([m for _, m in both]) @ model.layer + model.bias

    def softmax(t: float) -> np.ndarray:
        p = np.exp(z / t - (z / t).max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    grid = np.geomspace(0.05, 20, 121)
    model.temperature = float(min(grid, key=lambda t: -np.log(np.maximum(softmax(t)[np.arange(len(truth)), truth], 1e-12)).mean()))
    p = softmax(model.temperature)
    best, right = p.max(1), p.argmax(1) == truth
    order = np.argsort(-best, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision
    model.threshold = float(best[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether the row is in the fold that is never learnt from (null ids are not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, most: int = MOST, precision: float = 0.99) -> Model:
    """Learn from texts with a language outside the held-out fold. Ids, languages and hashes choose the sample, each
    partition first by itself; then its texts, at most `sample` * `most`, are joined and meet in one task. Of rows
    with one id any may be taken. Without a language the model predicts `und`."""
    spark = docs.sparkSession
    small_batches(spark)
    if sample > 1000:
        raise ValueError("sample is 1,000 at most")
    known = docs.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.xxhash64(doc_id, text).alias("h"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    first = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).select("lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    # a row's hash stands for it: equal hashes of a language are equal rows but by chance, and then both are taken
    some = known.select("lang", "h").withColumn("place", place).where(F.col("place") <= sample).groupBy("lang", "h").count()
    some = some.join(F.broadcast(first), "lang").select("lang", "h")
    chosen = known.join(F.broadcast(some), ["lang", "h"]).select("lang", "h", "text")
    shape = pa.schema([("model", pa.binary())])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[int, str], str | None] = {}
        for batch in batches:
            for lang_, h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows[h, lang_] = t
        model = fit([(k[1], rows[k]) for k in sorted(rows)], precision)
        yield pa.RecordBatch.from_arrays([pa.array([model.to_bytes()], pa.binary())], schema=shape)
        release()

    # equal rows of a hot hash are one before they meet
    got = chosen.dropDuplicates(["lang", "h"]).repartition(1).mapInArrow(fitted, "model binary").collect()
    return Model.from_bytes(bytes(got[0].model)) if got else fit([])


def score(df: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """df with lang_pred, score and rejected (each with `prefix` before it, made longer where df has the name). Texts
    without a letter (null, empty) are `und`, 0.0, true. All rows and columns are kept; no shuffle."""
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model.to_bytes())
    names = [new_name(df, f"{prefix}{c}") for c in ("lang_pred", "score", "rejected")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{n}` {t}" for n, t in zip(names, ("string", "double", "boolean"), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.from_bytes(shared.value)
        for batch in batches:
            got = [m.predict(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            new = [pa.array([x[j] for x in got], t) for j, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])
        release()

    return df.mapInArrow(run, schema)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    got = score(docs.select("doc_id", "text"), train(docs)).drop("text")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
