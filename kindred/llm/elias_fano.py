"""Elias-Fano sequences: n increasing 64-bit values in about 2 + log2(u / n) bits each, searched in place."""

from __future__ import annotations

import json

import numpy as np

_U = np.uint64
_ONE = _U(1)
#: Words of the upper bits between two counts of zeros.
BLOCK = 8


def pack_bits(values: np.ndarray, bits: int) -> np.ndarray:
    """The low `bits` bits of each value in a row, in 64-bit words, one more than needed."""
    words = np.zeros(len(values) * bits // 64 + 2, "<u8")
    out = words.view(np.uint8)
    for i in range(0, len(values) if bits else 0, 1 << 16):
        part = np.ascontiguousarray(values[i : i + (1 << 16)].astype("<u8")).view(np.uint8).reshape(-1, 8)
        raw = np.packbits(np.unpackbits(part, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little")
        out[i * bits // 8 : i * bits // 8 + len(raw)] = raw
    return words


class Sequence:
    """Values v[0] < v[1] < ...: `low` holds the low l bits of each, `high` one bit 1 at (v[i] >> l) + i, `zeros`
    how many 0 bits come before each block of `high`."""

    def __init__(self, n: int, l: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.l, self.low, self.high, self.zeros = n, l, low, high, zeros

    @staticmethod
    def of(values: np.ndarray) -> Sequence:
        n = len(values)
        if not n:
            return Sequence(0, 0, np.zeros(2, "<u8"), np.zeros(BLOCK, "<u8"), np.zeros(1, np.int64))
        l = max(0, (int(values[-1]) // n).bit_length() - 1)
        at = (values >> _U(l)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-(int(at[-1]) + 2) // (64 * BLOCK)) * 64 * BLOCK, np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        per = 64 * BLOCK - np.bitwise_count(high).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        return Sequence(n, l, pack_bits(values, l), high, np.concatenate([[0], np.cumsum(per)[:-1]]))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), _U)
        bit = i * self.l
        w, s = bit >> 6, (bit & 63).astype(_U)
        two = self.low[w] >> s
        two |= np.where(s > 0, self.low[w + 1] << ((_U(64) - s) & _U(63)), _U(0))
        return two & ((_ONE << _U(self.l)) - _ONE)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th 0 bit of `high`."""
        block = np.searchsorted(self.zeros, k, "right") - 1
        left = k - self.zeros[block]
        words = ~self.high[block[:, None] * BLOCK + np.arange(BLOCK)]
        upto = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        w = (upto <= left[:, None]).sum(axis=1)
        rows = np.arange(len(k))
        left -= np.where(w > 0, upto[rows, w - 1], 0)
        word, at = words[rows, w], (block * BLOCK + w) * 64
        for step in (32, 16, 8, 4, 2, 1):
            part = word & ((_ONE << _U(step)) - _ONE)
            count = np.bitwise_count(part).astype(np.int64)
            go = left >= count
            left -= np.where(go, count, 0)
            at += step * go
            word = np.where(go, word >> _U(step), part)
        return at

    def find(self, x: np.ndarray) -> np.ndarray:
        """The index of each x, or -1: the first value not below it, looked for among those that share its
        upper bits."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        todo = np.flatnonzero(x >> _U(self.l) <= _U(self._highest()))
        h, want = (x[todo] >> _U(self.l)).astype(np.int64), x[todo] & ((_ONE << _U(self.l)) - _ONE)
        # the values of upper bits h are lo to hi, between the zeros before and after them
        lo = np.where(h > 0, self._zero(np.maximum(h - 1, 0)) + 1 - h, 0)
        end = self._zero(h) - h
        hi = end.copy()
        go = np.flatnonzero(lo < hi)
        while len(go):
            mid = (lo[go] + hi[go]) >> 1
            below = self._low(mid) < want[go]
            lo[go] = np.where(below, mid + 1, lo[go])
            hi[go] = np.where(below, hi[go], mid)
            go = go[lo[go] < hi[go]]
        there = np.flatnonzero(lo < end)
        there = there[self._low(lo[there]) == want[there]]
        out[todo[there]] = lo[there]
        return out

    def _highest(self) -> int:
        if not hasattr(self, "_top"):
            w = int(np.flatnonzero(self.high[-2 * BLOCK :])[-1]) + max(0, len(self.high) - 2 * BLOCK)
            self._top = w * 64 + int(self.high[w]).bit_length() - self.n
        return self._top

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))
        return ((ones - np.arange(self.n)).astype(_U) << _U(self.l)) | self._low(np.arange(self.n))

    def arrays(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "zeros": self.zeros}


def to_bytes(head: dict, arrays: dict[str, np.ndarray]) -> bytes:
    """A JSON header of 8-byte aligned length and the arrays, each aligned."""
    at, places, parts = 0, {}, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        places[name] = [at, len(a), a.dtype.str]
        parts.append(raw + b"\0" * (-len(raw) % 8))
        at += len(parts[-1])
    text = json.dumps(head | {"arrays": places}).encode()
    text += b" " * (-(len(text) + 8) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(parts)


def from_buffer(raw: np.ndarray) -> tuple[dict, dict[str, np.ndarray]]:
    """Views of what to_bytes() wrote; raw: bytes, in memory or mapped."""
    n = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + n].tobytes())
    return head, {k: raw[8 + n + at : 8 + n + at + size * np.dtype(t).itemsize].view(t) for k, (at, size, t) in head["arrays"].items()}


def of_buffer(head: dict, arrays: dict[str, np.ndarray]) -> Sequence:
    return Sequence(head["n"], head["l"], arrays["low"], arrays["high"], arrays["zeros"])
