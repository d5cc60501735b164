"""Phrase collocations, mined by Toivonen's method.

Texts (A-Z lower-cased) are cut at `.,;:!?` and \\x0A-\\x0D into pieces, pieces into words at spaces and tabs. Per
language, phrases of 2 to `longest` words with at least `least` occurrences are found in these jobs:

1. All words are counted, and a bitmap is made of those with `least` occurrences.
2. A sample of the documents proposes phrases, level by level: those of k words whose first and last k - 1 words
   were proposed and that reach a lowered count in the sample join the bitmap.
3. One pass over all documents counts the proposed phrases and their negative border by their hashes. The border are
   the phrases that were not proposed although both parts of k - 1 words were; those that occur nowhere need no count.
4. Border phrases with `least` occurrences are failures. If there are any, a further pass counts all that was not
   counted yet and whose parts are proposed, failed, or hold a failure. It takes every length at once, so it closes
   the search: both parts of a phrase with `least` occurrences have as many, so each was counted before (and is
   proposed or failed) or in this pass (and holds a failure), and the pass lets both in.
5. The last pass counts the texts of all phrases whose hash has `least` occurrences. Most of the border has few, so
   its texts never leave the tasks.

The bitmap has a fixed size at every scale. Where two phrases share a bit or a hash, more phrases are counted than
needed; the last counts are of texts and exact, whatever the sample held. Groups of a task are told apart by dense
numbers of words (two 64-bit hashes a word, checked against each other), phrases by pairs of such numbers.

Edge rows: null texts have no words; a null language is `und`; a piece may be of any length; repeated rows
count each time; other columns are not looked at; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import drop_stored, release, small_batches, stored
from ._words import mix

#: The bitmap's size is 2**BITS bits.
BITS = 27
#: Bytes of text that a task counts at a time, and that it cuts into words at a time (ended at the next piece).
GROUP_BYTES, SLICE_BYTES = 4 << 20, 1 << 20
#: Phrases in a batch that goes back to Spark.
OUT_ROWS = 50_000

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?\n\x0b\x0c\r"]] = True
_WORD = ~_CUT
_WORD[[9, 32]] = False
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def _salt(lang: str) -> int:
    return int.from_bytes(blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _powers(k: int, n: int) -> np.ndarray:
    if n > len(_POWERS[k]):
        _POWERS[k] = np.cumprod(np.concatenate([[_U(1)], np.full(2 * n, _BASES[k], _U)]))
    return _POWERS[k]


class Words:
    """The words of some texts: two hashes and the piece of each, and their bytes, each followed by a space."""

    def __init__(self, texts: pa.Array, langs: list[str | None]):
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
        ends = at[1:] - at[0]
        b = _LOWER[np.insert(raw, ends, 10)]
        ends = ends + np.arange(1, len(ends) + 1)
        self.langs = ["" if x is None else x for x in langs]
        salts = {x: _salt(x) for x in set(self.langs)}
        salt = np.array([salts[x] for x in self.langs], _U)
        cuts = np.flatnonzero(_CUT[b])
        parts, lo, piece = [], 0, 0
        while lo < len(b):
            k = max(int(np.searchsorted(cuts, lo + SLICE_BYTES)) - 1, int(np.searchsorted(cuts, lo)))
            hi = int(cuts[k]) + 1
            got = self._slice(b[lo:hi], piece)
            start = got[2] + lo
            parts.append((*got[:2], start, got[3].astype(np.int32), *got[4:]))
            piece += int(_CUT[b[lo:hi]].sum())
            lo = hi
        h, g, start, size, pieces, kept = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, _U), np.empty(0, _U), *(np.empty(0, np.int64),) * 3, np.empty(0, np.uint8))
        self.doc = np.searchsorted(ends, start, "right")
        self.h, self.g, self.piece, self.bytes = mix(h ^ salt[self.doc]), mix(g + salt[self.doc]), pieces, kept
        self.at = np.concatenate([[0], np.cumsum(size + 1)])

    @staticmethod
    def _slice(b: np.ndarray, piece: int) -> tuple[np.ndarray, ...]:
        word = _WORD[b]
        before = np.concatenate([[False], word[:-1]])
        start, end = np.flatnonzero(word & ~before), np.flatnonzero(before & ~word)
        size = end - start
        inside = np.flatnonzero(word)
        digit, place = b[inside].astype(_U) + _U(1), inside - np.repeat(start, size)
        firsts = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else np.empty(0, np.int64)
        h, g = (np.add.reduceat(digit * _powers(k, int(size.max()))[place], firsts) if len(size) else np.empty(0, _U) for k in (0, 1))
        return h, g, start, size, piece + np.cumsum(_CUT[b])[start], np.where(word, b, 32)[word | before].astype(np.uint8)

    def keys(self, first: np.ndarray, k: int) -> pa.Array:
        """Of the phrases of k words from these: words joined by spaces, a line feed (no word has one), the language."""
        size = self.at[first + k] - self.at[first]
        out = np.concatenate([[0], np.cumsum(size)])
        data = self.bytes[np.arange(out[-1]) + np.repeat(self.at[first] - out[:-1], size)]
        data[out[1:] - 1] = 10
        text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(out.astype(np.int64)), pa.py_buffer(data)])
        names = sorted(set(self.langs))
        number = {x: j for j, x in enumerate(names)}
        each = np.array([number[x] for x in self.langs])[self.doc[first]]
        lang = pa.array([x.encode("utf-8", "surrogatepass") for x in names], pa.large_binary()).take(pa.array(each))
        return pc.binary_join_element_wise(text, lang, pa.scalar(b"", pa.large_binary())).cast(pa.binary())


def _numbered(key: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense numbers of equal keys, and for each number its first place and count. check: tells apart what has equal keys by chance."""
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    ordered = key[order]
    new[1:] = ordered[1:] != ordered[:-1]
    if check is not None and (~new[1:] & ((other := check[order])[1:] != other[:-1])).any():
        order = np.lexsort((check, key))
        new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
    starts = np.flatnonzero(new)
    number = np.empty(len(key), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return number, order[starts], np.diff(np.append(starts, len(key)))


def _in(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = (h >> _U(64 - BITS)).astype(np.int64)
    return (bitmap[bit >> 6] >> (bit & 63).astype(_U)) & _U(1) > 0


def levels(w: Words, longest: int, proposed: np.ndarray, failed: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For k from 2 on: of the distinct phrases of k words whose parts of k - 1 are both let in, the first place, the
    hash, the count, and whether both parts were let in without the failures. A phrase is let in if it is proposed,
    failed or holds one that failed."""
    number, first, _ = _numbered(w.h, w.g)
    h = w.h[first]
    live = old = _in(proposed, h)
    holds = np.zeros(len(h), bool)
    pos = np.arange(len(w.h), dtype=np.int32)
    for k in range(2, longest + 1):
        if len(pos) < 2:
            return
        ok = (pos[1:] == pos[:-1] + 1) & live[number[:-1]] & live[number[1:]]
        if k == 2:
            ok &= w.piece[1:] == w.piece[:-1]
        here = np.flatnonzero(ok)
        a, b = number[here], number[here + 1]
        pos = pos[here]
        number, first, count = _numbered((a.astype(_U) << _U(32)) | b.astype(_U))
        a, b = a[first], b[first]
        h = mix(mix(h[a] + _U(k)) * _U(0xD6E8FEB86659FD93) + h[b])
        counted = old[a] & old[b]
        yield k, pos[first], h, count, counted
        old = _in(proposed, h) & counted
        holds = holds[a] | holds[b] | (_in(failed, h) if failed is not None else False)
        live = old | holds


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Columns text and lang, some batches at a time."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(0).nbytes
        if size >= GROUP_BYTES:
            yield _words_of(held)
            held, size = [], 0
    if held:
        yield _words_of(held)


def _words_of(held: list[pa.RecordBatch]) -> Words:
    t = pa.Table.from_batches(held)
    return Words(pa.concat_arrays([c.cast(pa.large_binary()) for c in t.column(0).chunks]), t.column(1).to_pylist())


def _rows(w: Words, first: np.ndarray, k: int, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(first), OUT_ROWS):
        yield pa.RecordBatch.from_arrays([w.keys(first[i : i + OUT_ROWS], k), pa.array(count[i : i + OUT_ROWS].astype(np.int64))], names=["key", "n"])


def _hash_rows(h: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(h), OUT_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(h[i : i + OUT_ROWS].view(np.int64)), pa.array(count[i : i + OUT_ROWS].astype(np.int64))], names=["h", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, n): all words of (text, lang) by language, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _groups(batches):
            _, first, count = _numbered(w.h, w.g)
            yield from _rows(w, first, 1, count)
        release()

    return docs.mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


def phrase_hashes(docs: DataFrame, proposed: np.ndarray, longest: int, failed: np.ndarray | None = None) -> DataFrame:
    """(h, n): the hashes of the phrases of (text, lang) that are proposed or in the border, counted; the last bit says
    that the phrase has `longest` words. failed: only those that the pass without it did not count."""
    shared = docs.sparkSession.sparkContext.broadcast((proposed, failed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, lost = shared.value
        for w in _groups(batches):
            for k, _, h, count, counted in levels(w, longest, bits, lost):
                h = (h & ~_U(1)) | _U(k == longest)
                if lost is not None:
                    h, count = h[~counted], count[~counted]
                yield from _hash_rows(h, count)
        release()

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, wanted: np.ndarray, longest: int) -> DataFrame:
    """(key, n): the phrases of (text, lang) that are wanted and whose parts are, counted."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _groups(batches):
            for k, first, h, count, _ in levels(w, longest, shared.value):
                some = _in(shared.value, h)
                yield from _rows(w, first[some], k, count[some])
        release()

    return docs.mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


def sample_level(docs: DataFrame, proposed: np.ndarray, k: int) -> DataFrame:
    """(h, n): the hashes of the phrases of k words with both parts proposed, counted in the sample."""
    shared = docs.sparkSession.sparkContext.broadcast(proposed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _groups(batches):
            for level, _, h, count, _ in levels(w, k, shared.value):
                if level == k:
                    yield from _hash_rows(h, count)
        release()

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _hashed(words: DataFrame) -> DataFrame:
    """The hashes h of words in (key, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [x.split(b"\n", 1) for x in batch.column("key").to_pylist()]
            w = Words(pa.array([x[0] for x in both], pa.large_binary()), [x[1].decode("utf-8", "surrogatepass") for x in both])
            yield pa.RecordBatch.from_arrays([pa.array(w.h.view(np.int64))], names=["h"])

    return words.mapInArrow(run, "h long")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """The bitmap of the column h: at most 2**BITS / 64 rows reach the driver, however many hashes there are."""
    bit = hashes.select(F.shiftrightunsigned("h", 64 - BITS).alias("bit"))
    got = bit.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63L AS INT))")).alias("bits")).toArrow()
    out = np.zeros((1 << BITS) // 64, _U)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(_U)
    return out


def _outside(hashes: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """Those of (h, n) that are not in the bitmap."""
    shared = hashes.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~_in(shared.value, batch.column("h").to_numpy().view(_U))))

    return hashes.mapInArrow(run, "h long, n long")


def _parts(keys: DataFrame) -> DataFrame:
    """(key, n) -> (key, n, lang, w: the words, k: their number)."""
    text, lang = (F.split(F.col("key").cast("string"), "\n", 2)[j] for j in (0, 1))
    return keys.withColumn("lang", lang).withColumn("w", F.split(text, " ")).withColumn("k", F.size("w"))


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(lang, w, k, n) of all phrases of 1 to `longest` words with `least` occurrences, and (lang, n) of all words.
    docs: (text, lang), lang not null. share: of the documents, for the sample; any share gives the same result.

    Rows are drawn one by one, so copies of a text are drawn apart."""
    small_batches(docs.sparkSession)
    words = stored(word_counts(docs), "word-counts")
    known = words.where(F.col("n") >= least)
    bitmap = frequent = _bitmap(_hashed(known))
    sample = stored(docs.where(F.rand(17) < share), "sample")
    enough = max(2, int(share * least - 3 * (share * least) ** 0.5))
    for k in range(2, longest):
        bitmap = bitmap | _bitmap(sample_level(sample, bitmap, k).where(F.col("n") >= enough))
    drop_stored(sample)
    many = stored(phrase_hashes(docs, bitmap, longest).where(F.col("n") >= least), "hashes")
    lost = stored(_outside(many.where("h & 1 = 0"), bitmap), "border-failures")
    if not lost.isEmpty():
        many = many.unionByName(stored(phrase_hashes(docs, bitmap, longest, _bitmap(lost)).where(F.col("n") >= least), "hashes"))
    found = stored(phrase_counts(docs, frequent | _bitmap(many), longest).where(F.col("n") >= least), "phrases")
    every = known.unionByName(found)
    total = words.withColumn("lang", F.split(F.col("key").cast("string"), "\n", 2)[1]).groupBy("lang").agg(F.sum("n").alias("n"))
    return _parts(every).select("lang", "w", "k", F.col("n")), total


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, top: int = 2000, percent: int = 100, share: float = 0.2) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score.

    a: occurrences of the phrase, l and r: of its first part and the rest at the cut with the lowest score (ties: the
    smallest first part), n: all words; score: floor(1000 * a * n / (l * r)) in decimals of 38 digits. Phrases inside
    a longer one with at least `percent` hundredths of their occurrences are dropped: as a part has no fewer
    occurrences than the whole, it is enough to look at those one word longer."""
    rows = docs.select(F.col(text).alias("text"), F.coalesce(lang, F.lit("und")).alias("lang"))
    found, total = frequent_phrases(rows, least, longest, share)
    found = stored(found.select("lang", F.array_join("w", " ").alias("phrase"), "w", "k", F.col("n").alias("a")), "frequent")
    total = stored(total, "totals")
    longer = found.where("k > 2").select("lang", F.explode(F.array(F.array_join(F.expr("slice(w, 1, k - 1)"), " "), F.array_join(F.expr("slice(w, 2, k - 1)"), " "))).alias("phrase"), F.col("a").alias("more"))
    longer = stored(longer.groupBy("lang", "phrase").agg(F.max("more").alias("more")), "longer")
    kept = found.where("k > 1").join(longer.hint("merge"), ["lang", "phrase"], "left").where(F.coalesce(F.col("more") * 100 < F.col("a") * percent, F.lit(True)))
    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("k"), F.size("w").alias("size"))
    cuts = stored(cuts.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("left"), F.array_join(F.expr("slice(w, k + 1, size - k)"), " ").alias("right")), "cuts")
    count = found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("n_part"))
    for side, to in (("left", "l"), ("right", "r")):
        cuts = cuts.join(count.withColumnsRenamed({"part": side, "n_part": to}).hint("merge"), ["lang", side]).drop(side)
    cuts = cuts.join(total.hint("merge"), "lang") if total.count() > 10_000 else cuts.join(F.broadcast(total), "lang")
    exact = F.expr("CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(15,0)) * CAST(n AS DECIMAL(19,0)) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    best = cuts.withColumn("score", exact).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first of each of 64 parts of a language, then of these
    some = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
