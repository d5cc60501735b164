"""Language-model scoring with an n-gram trie of Elias-Fano levels.

Tokens are words (A-Z lower-cased, white space apart) and an end after each text. Level 1 has all
words by hash; an n-gram of level k is its parent's rank in level k - 1 times the number of words plus
its last word's rank, so the children of a context are one run of an increasing sequence, found by a
successor search from the context's own base; the pointers are folded into the sequence. Kept are
n-grams of MIN_COUNT occurrences. Probabilities are interpolated by absolute discounting, stored as
quantised log10 beside the n-grams, with a back-off weight for each context, and sum to 1.

Counts are made where the texts are, merged by ranges of keys, and each range is one file of a level:
no task or machine holds a level whole. Tasks map the files into memory."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words as W
from . import elias_fano as EF
from ._common import drop_stored, new_dir, small_batches, stored
from ._files import make_dir, read_range, store, write_whole

ORDER, MIN_COUNT, DISCOUNT = 3, 2, 0.75
#: Steps of a log10 in the 16 bits of a stored probability.
STEPS = 4096
#: Keys that a task gathers before it sends them on.
GATHERED = 3_000_000
_U = np.uint64
END = W.mix(np.array([0xE0F], _U))[0]


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * STEPS), 0, 65535).astype(np.uint16)


@lru_cache(maxsize=20_000)
def _mapped(uri: str) -> tuple[dict, dict[str, np.ndarray], EF.Sequence]:
    at, path = store(uri)
    raw = np.memmap(path, np.uint8, "r") if isinstance(at, fs.LocalFileSystem) else np.frombuffer(read_range(uri), np.uint8)
    head, arrays = EF.from_buffer(raw)
    return head, arrays, EF.of_buffer(head, arrays)


@dataclass
class Level:
    """Files by range of keys: range k has the keys from k * step on, and the ranks from bases[k] on."""

    step: int
    files: list[str | None]
    bases: list[int]

    def _each(self, part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.diff(part[order])) + 1
        for rows in np.split(order, cut):
            if len(rows):
                yield int(part[rows[0]]), rows

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ranks, -1 where a key is not kept."""
        out = np.full(len(keys), -1, np.int64)
        for k, rows in self._each((keys // _U(self.step)).astype(np.int64)):
            if k < len(self.files) and self.files[k]:
                i = _mapped(self.files[k])[2].find(keys[rows] - _U(k * self.step))
                out[rows] = np.where(i >= 0, i + self.bases[k], -1)
        return out

    def take(self, name: str, ranks: np.ndarray) -> np.ndarray:
        """The stored array's value at each rank (none may be -1)."""
        out = np.zeros(len(ranks), np.float64)
        bases = np.array(self.bases)
        for k, rows in self._each(np.searchsorted(bases, ranks, "right") - 1):
            out[rows] = _mapped(self.files[k])[1][name][ranks[rows] - self.bases[k]]
        return out

    def backoff(self, parents: np.ndarray, width: int) -> np.ndarray:
        """log10 of the back-off weight of each context (a rank of the level below, or -1)."""
        out = np.zeros(len(parents), np.float64)
        some = np.flatnonzero(parents >= 0)
        for k, rows in self._each(parents[some] // width):
            if k < len(self.files) and self.files[k]:
                out[some[rows]] = _mapped(self.files[k])[1]["back"][parents[some[rows]] - k * width] / -STEPS
        return out


@dataclass
class Model:
    tokens: int = 0
    words: int = 0
    levels: list[Level] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)

    def width(self, level: int) -> int:
        """Contexts in a range of level `level` (2 or more)."""
        return self.levels[level - 1].step // max(1, self.words)

    def ranks(self, tok: np.ndarray, depth: np.ndarray, upto: int) -> list[np.ndarray]:
        """For levels 1 to upto the rank of the n-gram that ends at each token, -1 where not kept. depth: how
        many tokens of the text come before."""
        out: list[np.ndarray] = []
        for level in range(1, upto + 1):
            if level > len(self.levels):
                out.append(np.full(len(tok), -1, np.int64))
                continue
            if level == 1:
                ok, key = np.arange(len(tok)), tok
            else:
                key, ok = self.keys(out, depth, level)
            some, back = np.unique(key, return_inverse=True)
            got = np.full(len(tok), -1, np.int64)
            got[ok] = self.levels[level - 1].find(some)[back]
            out.append(got)
        return out

    def keys(self, ranks: list[np.ndarray], depth: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the n-grams of a level whose parent, and the n-gram without its first word, are kept."""
        parent, suffix = ranks[level - 2], ranks[level - 2]
        ok = np.flatnonzero((depth[1:] >= level - 1) & (parent[:-1] >= 0) & (suffix[1:] >= 0)) + 1
        return parent[ok - 1].astype(_U) * _U(self.words) + ranks[0][ok].astype(_U), ok


    def unigram(self, ranks: np.ndarray) -> np.ndarray:
        """log10 of (c + 0.5) / (N + 0.5 (V + 1)); rank -1: c is 0."""
        c = np.zeros(len(ranks))
        some = ranks >= 0
        c[some] = self.levels[0].take("counts", ranks[some]) if some.any() else c[some]
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.words + 1)))

    def lower(self, parent: np.ndarray, word: np.ndarray, level: int) -> np.ndarray:
        """log10 of the probability of a word after a context of level - 1 words without its first one."""
        if level == 2:
            return self.unigram(word)
        # the context's last words: a rank's key names its parent and its last word
        context = self.levels[level - 2]
        last = np.zeros(len(parent), np.int64)
        for k, rows in context._each(np.searchsorted(np.array(context.bases), parent, "right") - 1):
            keys = _mapped(context.files[k])[2].values()
            last[rows] = (keys[parent[rows] - context.bases[k]] % _U(self.words)).astype(np.int64)
        if level == 3:
            r = self.levels[1].find(last.astype(_U) * _U(self.words) + word.astype(_U))
            out = np.zeros(len(r))
            out[r >= 0] = self.levels[1].take("p", r[r >= 0]) / -STEPS
            miss = np.flatnonzero(r < 0)
            out[miss] = self.levels[1].backoff(last[miss], self.width(2)) + self.unigram(word[miss])
            return out
        raise ValueError("levels above 3 are not built")


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of texts, how many of the text come before each, and the texts' offsets."""
    h, _, _, doc = W.words(raw, at)
    size = np.diff(doc) + 1
    off = np.concatenate([[0], np.cumsum(size)])
    tok = np.full(off[-1], END, _U)
    tok[np.arange(len(h)) + np.repeat(np.arange(len(size)), size - 1)] = h
    return tok, np.arange(len(tok)) - np.repeat(off[:-1], size), off


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    new = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
    return k[new], np.add.reduceat(c, new) if len(k) else c


def _chunk(keys: np.ndarray, counts: np.ndarray) -> bytes:
    s = EF.Sequence.of(keys)
    extra = counts.astype(np.int64)
    return EF.to_bytes({"n": s.n, "l": s.l}, s.arrays() | {"counts": np.frombuffer(zlib.compress(extra.tobytes(), 1), np.uint8)})


def _unchunk(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    head, arrays = EF.from_buffer(np.frombuffer(raw, np.uint8))
    return EF.of_buffer(head, arrays).values(), np.frombuffer(zlib.decompress(arrays["counts"].tobytes()), np.int64)


def _count(docs: DataFrame, keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray], step: int, least: int, name: str) -> DataFrame:
    """part, n, total, data (sorted keys from part * step on, and counts) of all keys with `least` counts or more;
    stored. Each task sends its own sums, compressed, by range; a range is merged in one task."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def send() -> Iterator[pa.RecordBatch]:
            k, c = _merged(keys, counts)
            part = k // _U(step)
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(k) else np.empty(0, np.int64)
            rows = [(int(part[i]), _chunk(k[i:j] - part[i] * _U(step), c[i:j])) for i, j in zip(cut, np.append(cut, len(k))[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "data"])

        for batch in batches:
            raw, at = W.text_bytes(batch.column(0))
            for i, j in W.slices(at):
                tok, depth, _ = tokens(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                k, c = np.unique(keys_of(tok, depth), return_counts=True)
                keys.append(k)
                counts.append(c.astype(np.int64))
                held += len(k)
                if held > GATHERED:
                    k, c = _merged(keys, counts)
                    keys[:], counts[:], held = [k], [c], len(k)
                    if held > GATHERED // 2:
                        yield from send()
                        keys.clear()
                        counts.clear()
                        held = 0
        if keys:
            yield from send()

    def merge(table: pa.Table) -> pa.Table:
        k, c = _merged(*zip(*map(_unchunk, table.column("data").to_pylist()), strict=True))
        total = int(c.sum())
        k, c = k[c >= least], c[c >= least]
        return pa.table({"part": table.column("part")[:1], "n": pa.array([len(k)], pa.int64()), "total": pa.array([total], pa.int64()), "data": pa.array([_chunk(k, c)], pa.binary())})

    small_batches(docs.sparkSession)
    sent = docs.select("text").mapInArrow(gather, "part int, data binary")
    return stored(sent.groupBy("part").applyInArrow(merge, "part int, n long, total long, data binary"), name)


def _build(counted: DataFrame, write: Callable[[int, np.ndarray, np.ndarray], tuple[dict, dict]], out_dir: str, step: int, parts: int) -> tuple[Level, int]:
    """Write a level's files and return it with its size. What the driver gets is a line a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts = _unchunk(raw)
                s = EF.Sequence.of(keys)
                head, arrays = write(part, keys, counts)
                name = f"{out_dir}/{part:07d}.ef"
                write_whole(name, EF.to_bytes(head | {"n": s.n, "l": s.l}, s.arrays() | arrays))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([name])], names=["part", "n", "file"])

    make_dir(out_dir)
    spark = counted.sparkSession
    small_batches(spark, 4)
    made = stored(counted.where("n > 0").select("part", "data").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").mapInArrow(run, "part int, n long, file string"), "level")
    small_batches(spark)
    files: list[str | None] = [None] * parts
    sizes = [0] * parts
    for r in made.collect():
        files[r.part], sizes[r.part] = r.file, r.n
    bases = np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist()
    return Level(step, files, bases), sum(sizes)


def train(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT) -> Model:
    """Count and build the levels from docs(text); null is an empty text, which has an end. Without rows the
    model is empty: it knows no word."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out_dir = new_dir(spark, "trie")
    model = Model()
    step = -(-(1 << 64) // parts)
    counted = _count(docs, lambda tok, depth: tok, step, 1, "words")
    sums = counted.agg(F.sum("n"), F.sum("total")).first()
    model.words, model.tokens = int(sums[0] or 0), int(sums[1] or 0)
    if not model.words:
        return model
    level, size = _build(counted, lambda part, keys, counts: ({}, {"counts": counts}), f"{out_dir}/1", step, parts)
    drop_stored(counted)
    model.levels.append(level)
    model.sizes.append(size)
    for k in range(2, order + 1):
        if not model.sizes[-1]:
            break
        width = -(-model.sizes[-1] // parts)
        step = width * model.words
        below = Model(model.tokens, model.words, list(model.levels), list(model.sizes))

        def keys_of(tok: np.ndarray, depth: np.ndarray, below: Model = below, k: int = k) -> np.ndarray:
            return below.keys(below.ranks(tok, depth, k - 1), depth, k)[0]

        def write(part: int, keys: np.ndarray, counts: np.ndarray, below: Model = below, k: int = k, width: int = width) -> tuple[dict, dict]:
            parent, word = (keys // _U(below.words)).astype(np.int64), (keys % _U(below.words)).astype(np.int64)
            some, back = np.unique(parent, return_inverse=True)
            total = below.levels[k - 2].take("counts", some + part * width)
            free = 1 - np.bincount(back, counts - DISCOUNT) / total
            log_free = np.log10(np.clip(free, 1e-9, 1))
            lower = below.lower(parent + part * width, word, k)
            p = (counts - DISCOUNT) / total[back] + 10 ** (log_free[back] + lower)
            gaps = np.zeros(width, np.uint16)
            gaps[some] = quantise(log_free)
            return {}, {"counts": counts.astype(np.uint32), "p": quantise(np.log10(np.minimum(p, 1))), "back": gaps}

        counted = _count(docs, keys_of, step, min_count, f"grams{k}")
        level, size = _build(counted, write, f"{out_dir}/{k}", step, parts)
        drop_stored(counted)
        model.levels.append(level)
        model.sizes.append(size)
    return model


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs(doc_id, text), whole; a null
    or empty text is an end alone. No shuffle."""
    small_batches(docs.sparkSession)
    order = max(1, len(model.levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = W.text_bytes(batch.column(1))
            for i, j in W.slices(at):
                tok, depth, off = tokens(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                ranks = model.ranks(tok, depth, order)
                base = model.unigram(ranks[0])
                p = base.copy()
                for level in range(2, len(model.levels) + 1):
                    context = np.where(depth >= level - 1, np.append(-1, ranks[level - 2][:-1]), -1)
                    p += model.levels[level - 1].backoff(context, model.width(level))
                    met = ranks[level - 1] >= 0
                    if met.any():
                        p[met] = model.levels[level - 1].take("p", ranks[level - 1][met]) / -STEPS
                known = np.add.reduceat((ranks[0] >= 0).astype(np.int64), off[:-1])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), pa.array(np.diff(off)), pa.array(known), pa.array(np.full(j - i, model.tokens)),
                    pa.array(np.add.reduceat(base, off[:-1])), pa.array(np.add.reduceat(p, off[:-1])),
                ], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def scored(docs: DataFrame) -> DataFrame:
    """Every document's scores by a model of the documents outside the held-out fold."""
    out = score(docs, train(docs.where(~held_out(F.col("doc_id")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
