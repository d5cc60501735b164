"""Embedding whitening by shifted CholeskyQR.

Each component c of a vector, as a double, becomes the long x = floor(64 * c) + 1000000. With n vectors and exact sums
S, a centred row is the exact long n * x - S, divided by n as a double. Passes over the rows, each a Gram matrix summed
by Spark, orthogonalise them: a pass solves the rows by the triangles so far, one after the other, takes the Gram
matrix of the result, adds a shift if it has no Cholesky factor otherwise, and composes the factor with R. They end
once the Gram matrix is the identity but for rounding. The singular values and right vectors of R (weighed by the last
Gram matrix) are the components; no pass multiplies rows that are not centred.

Components whose singular value is under RANK times the first are no direction of the data (a constant component, one
that repeats others, fewer vectors than dimensions) and are left out; so are all if the vectors are equal. A
component's sign makes its largest entry positive."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import release, stored

SCALE, OFFSET = 64, 1_000_000
#: Passes at most, the distance from the identity at which they end, and the least singular value by the first.
PASSES, CLOSE, RANK = 6, 1e-11, 1e-11
#: Rows of a batch that are multiplied at a time.
ROWS = 4096


def _matrices(batches: Iterator[pa.RecordBatch], column: str, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, part.column(part.schema.get_field_index(column)).flatten().to_numpy().reshape(-1, dims)


def integers(df: DataFrame, embedding: str = "embedding", to: str = "x") -> DataFrame:
    """The rows whose vector is neither null nor empty and holds no null and no entry that is not finite, with its
    longs in place of it."""
    e = F.col(embedding)
    good = F.coalesce((F.size(e) > 0) & F.forall(e, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))), F.lit(False))
    return df.where(good).withColumn(to, F.transform(e, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET).cast("long"))).drop(*([embedding] if embedding != to else []))


def solve(a: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """a times the inverse of each upper triangle, by forward substitution over the columns of all rows at once."""
    for r in factors:
        q = np.empty_like(a)
        for j in range(a.shape[1]):
            q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        a = q
    return a


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (x * n - sums) / float(n)


@dataclass
class Whitening:
    """components: one a row; eigenvalue: of the covariance with divisor n; total: its trace. passes: Gram passes made."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalue: np.ndarray
    total: float
    passes: int = 0
    identity_error: float = 0.0

    def apply(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ (self.components / np.sqrt(self.eigenvalue)[:, None]).T


def _summed(rows: DataFrame, function, dims: int, width: int) -> np.ndarray:
    """The sum of a width x width matrix over all batches: each task adds up its own, Spark the entries of all tasks.
    The driver gets width * width numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, x in _matrices(batches, "x", dims):
            total += function(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["at", "v"])
        release()

    got = rows.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(width * width)
    out[got.column("at").to_numpy()] = got.column("v").to_numpy()
    return out.reshape(width, width)


def fit(rows: DataFrame, most: int = 32) -> Whitening | None:
    """Of a table with the column x, arrays of longs of one length; other lengths raise ValueError, and longs for which
    the sums or n * x leave 64 bits OverflowError. None without rows."""
    sizes = rows.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi"), F.min(F.array_min("x")).alias("least"), F.max(F.array_max("x")).alias("most")).first()
    if not sizes.n:
        return None
    if sizes.lo != sizes.hi:
        raise ValueError(f"vectors of {sizes.lo} and of {sizes.hi} components")
    n, dims = sizes.n, sizes.lo
    if max(abs(sizes.least), abs(sizes.most)) * max(n, ROWS) >= 2**62:
        raise OverflowError("n * x leaves 64 bits")

    def adding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for _, x in _matrices(batches, "x", dims):
            total = [a + int(b) for a, b in zip(total, x.sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(total, pa.int64())], names=["at", "v"])

    sums = np.zeros(dims, np.int64)
    for r in rows.select("x").mapInArrow(adding, "at int, v long").groupBy("at").agg(F.sum("v").alias("v")).collect():
        sums[r["at"]] = r.v

    factors: list[np.ndarray] = []
    whole, passes, total = np.eye(dims), 0, 0.0
    while True:
        given = list(factors)

        def gram(x: np.ndarray) -> np.ndarray:
            q = solve(centred(x, n, sums), given)
            return q.T @ q

        g = _summed(rows, gram, dims, dims)
        g = (g + g.T) / 2
        passes += 1
        if passes == 1:
            total = float(np.trace(g)) / n
            if not total:
                return Whitening(n, sums, np.empty((0, dims)), np.empty(0), 0.0, passes)
        size, turn = np.linalg.eigh(g)
        live = size > 0.5  # directions of no length stay at 0 in every pass
        if passes > 1 and (abs(size[live] - 1) < CLOSE).all() and (size[~live] < CLOSE).all() or passes == PASSES:
            break
        # the first pass may meet any condition; a later one needs a shift only for directions of no length
        shift = min(11 * (n * dims + dims * (dims + 1)) * 2.0**-53, 1e-3) if passes == 1 else (1e-13 if size[0] < 1e-13 * size[-1] else 0.0)
        r = np.linalg.cholesky(g + shift * float(size[-1]) * np.eye(dims)).T
        factors.append(np.ascontiguousarray(r))
        whole = r @ whole
    _, s, v = np.linalg.svd(np.sqrt(np.maximum(size, 0))[:, None] * (turn.T @ whole))
    k = int((s > RANK * s[0]).sum())
    v, s = v[: min(k, most)], s[: min(k, most)]
    v *= np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
    out = Whitening(n, sums, v, s * s / n, total, passes)
    if len(v):
        # the covariance of what comes out, again centred first
        width = len(v)

        def second(x: np.ndarray) -> np.ndarray:
            w = np.column_stack([out.apply(x), np.ones(len(x))])
            return w.T @ w

        g = _summed(rows, second, dims, width + 1)
        mean = g[-1, :-1] / n
        out.identity_error = float(np.abs(g[:-1, :-1] / n - np.outer(mean, mean) - np.eye(width)).max())
    return out


def transform(rows: DataFrame, model: Whitening, to: str = "whitened") -> DataFrame:
    """rows (with x) and the column `to`, the whitened components; all other columns stay. No shuffle."""
    rest = rows.drop(to)
    dims = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, "x", dims):
            w = model.apply(x)
            at = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(at, pa.array(w.ravel()))], names=[*part.schema.names, to])
        release()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), f"`{to}` array<double>"])
    return rest.mapInArrow(run, schema)


def deviations(rows: DataFrame, model: Whitening, to: str = "deviation") -> DataFrame:
    """rows (with x) and the exact sum of (n * x - S)^2 over the components; outside 64 bits it raises."""
    dims, n, sums = len(model.sums), model.n, model.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, "x", dims):
            d = x * n - sums
            if np.square(d.astype(float)).sum(1).max(initial=0) < 2.0**62:
                got = pa.array(np.square(d).sum(1))
            else:
                got = pa.array([sum(int(v) ** 2 for v in row) for row in d], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns, got], names=[*part.schema.names, to])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{to}` long"])
    return rows.mapInArrow(run, schema)


def whitened(df: DataFrame, most: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row and component.

    Rows with null, empty or not finite vectors are left out; vectors of more than one length raise ValueError. Null
    and repeated vec_id count as rows of their own. Without rows, or if all vectors are equal, there are no rows."""
    spark = df.sparkSession
    rows = stored(integers(df.select("vec_id", "embedding")), "vectors")
    model = fit(rows, most)
    if model is None or not len(model.components):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    got = transform(deviations(rows, model), model).drop("x")
    explained = F.array(*[F.lit(float(e / model.total)) for e in model.eigenvalue])
    each = got.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("k") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
