"""Vectorised words, shingles and hashes over the UTF-8 bytes of an Arrow column of texts.

Words are the runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased. As those are all
ASCII, a split of the bytes is a split of the characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = _U(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1, _U)
#: Bytes of text handled at a time; a longer document is a slice by itself.
SLICE_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the column and the n + 1 offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - at[0] if len(at) else np.zeros(1, np.int64)


def slices(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most SLICE_BYTES together, or of one document."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, "right")) - 1)
        yield i, j
        i = j


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts at raw[at[i]:at[i+1]]: each word's 64-bit hash, its first byte and the one after its
    last, and n + 1 offsets of the documents' words."""
    global _POWERS
    b = _LOWER[raw]
    word = np.empty(len(b) + 1, bool)
    word[:-1] = ~_SPACE[b]
    word[-1] = False
    before = np.empty(len(b) + 1, bool)
    before[0] = False
    before[1:] = word[:-1]
    cut = np.zeros(len(b) + 1, bool)
    cut[at] = True
    start = np.flatnonzero(word & (~before | cut))
    end = np.flatnonzero(before & (~word | cut))
    if not len(start):
        return np.empty(0, _U), start, end, np.zeros(len(at), np.int64)
    size = end - start
    if size.max() > len(_POWERS):
        _POWERS = np.cumprod(np.concatenate([[_U(1)], np.full(int(size.max()) * 2, _P, _U)]))
    inside = np.flatnonzero(word)
    first = np.repeat(start, size)
    # bytes are non-zero digits of a polynomial in an odd number, modulo 2**64
    h = np.add.reduceat((b[inside].astype(_U) + _U(1)) * _POWERS[inside - first], np.concatenate([[0], np.cumsum(size)[:-1]]))
    return mix(h), start, end, np.searchsorted(start, at)


def shingles(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of a document, in order, and the documents' offsets. A document
    of fewer words, but not none, has its whole sequence as one."""
    n = np.diff(doc)
    if len(h) >= k:
        s = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            s = mix(s * _U(0xD6E8FEB86659FD93) + h[j : len(h) - k + 1 + j])
        ok = np.ones(len(h), bool)
        ok[len(s) :] = False
        for j in range(1, k):
            gone = doc[1:] - j
            ok[gone[(gone >= 0) & (n >= j)]] = False
    else:
        s, ok = np.empty(0, _U), np.zeros(len(h), bool)
    out_n = np.where(n >= k, n - k + 1, 0)
    short = np.flatnonzero((n > 0) & (n < k))
    if not len(short):
        return s[ok[: len(s)]], np.concatenate([[0], np.cumsum(out_n)])
    out_n[short] = 1
    at = np.concatenate([[0], np.cumsum(out_n)])
    out = np.empty(at[-1], _U)
    is_short = np.zeros(at[-1], bool)
    is_short[at[short]] = True
    out[~is_short] = s[ok[: len(s)]]
    for d in short:
        v = np.array([0xA5A5A5A5], _U)
        for x in h[doc[d] : doc[d + 1]]:
            v = mix(v * _U(0x2545F4914F6CDD1D) + x)
        out[at[d]] = v[0]
    return out, at
