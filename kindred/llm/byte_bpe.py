"""Byte-level BPE encoding and decoding with the tokenizers library, from a file of ranks.

Ranks (base64 token, rank, a line each) become a tokenizers BPE model: every byte is written as one
printable character, and every way to cut a token into two tokens is a merge at the token's rank, so
that the pair whose join has the lowest rank is merged first, leftmost on ties. Texts come in Arrow
batches. They are cut at white space (each chunk with the one space before it), which the split
pattern never crosses; a chunk's ids are kept and the library encodes those not met before."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import release, small_batches

#: White space as the split pattern has it.
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
CHUNK_IS_SPACE = re.compile(f"[{SPACE}]")
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Chunks whose ids a worker keeps, and the longest that is kept.
KEPT_CHUNKS, KEPT_LENGTH = 150_000, 48
#: Characters cut to chunks at a time; a longer text is cut in turns, each up to a chunk's end.
TURN = 1 << 18
#: New chunks that the library encodes as one text.
JOINED = 100


def byte_table() -> list[str]:
    """A printable character for each byte: itself where it prints, else those from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Coder:
    """Encodes and decodes with one file of ranks."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        chars = byte_table()
        named = {t: "".join(chars[b] for b in t) for t in ranks}
        merges = [(named[t[:i]], named[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.tokenizer = Tokenizer(models.BPE(vocab={named[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: From an id to its bytes, by the table read the other way.
        back = {c: b for b, c in enumerate(chars)}
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for name, r in ((n, ranks[t]) for t, n in named.items()):
            self.bytes[r] = bytes(back[c] for c in name)
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.kept: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null is empty. Some texts, or a part of
        a long one, are cut to chunks at a time."""
        out: list[bytes] = []
        turn: list[list[str]] = []
        size = 0
        for t in texts:
            if t and len(t) > TURN:
                out += self._encode(turn)
                turn, size = [], 0
                out.append(b"".join(x for part in self._parts(t) for x in self._encode([part])))
                continue
            turn.append(CHUNK.findall(t) if t else [])
            size += len(t or "")
            if size > TURN:
                out += self._encode(turn)
                turn, size = [], 0
        return out + self._encode(turn)

    @staticmethod
    def _parts(text: str) -> Iterator[list[str]]:
        """The chunks of a long text, some at a time."""
        at, wide = 0, TURN
        while at < len(text):
            got = CHUNK.findall(text, at, at + wide)
            if at + wide < len(text):
                del got[-2:]  # the cut may have changed them
                if not got:
                    wide *= 2
                    continue
            yield got
            at, wide = at + sum(map(len, got)), TURN

    def _encode(self, chunked: list[list[str]]) -> list[bytes]:
        if len(self.kept) > KEPT_CHUNKS:
            self.kept.clear()
        new = set().union(*chunked).difference(self.kept) if chunked else set()
        # a space and what follows it start a piece wherever they stand, so such chunks can be encoded joined
        spaced = [c for c in new if len(c) > 1 and c[0] == " " and not CHUNK_IS_SPACE.match(c, 1)]
        self._add([spaced[i : i + JOINED] for i in range(0, len(spaced), JOINED)])
        self._add([[c] for c in new.difference(spaced)])
        out = [b"".join(map(self.kept.__getitem__, c)) for c in chunked]
        for c in (c for c in new if len(c) > KEPT_LENGTH):
            del self.kept[c]
        return out

    def _add(self, groups: list[list[str]]) -> None:
        """Keep the ids of the chunks of each group, encoded as one text."""
        for i in range(0, len(groups), 64):
            part = groups[i : i + 64]
            for group, e in zip(part, self.tokenizer.encode_batch_fast(["".join(g) for g in part], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                raw = ids.tobytes()
                # tokens end where chunks end, so bytes tell which ids are whose
                cut = (4 * np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(c.encode()) for c in group]), "left") + 4).tolist()
                at = 0
                for c, to in zip(group, cut, strict=True):
                    self.kept[c] = raw[at:to]
                    at = to

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes of the ids together; a character cut between tokens is whole again only here."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))

    def char_offsets(self, text: str, ids: bytes) -> list[tuple[int, int]]:
        """For each id the characters [start, end) of text that its bytes touch."""
        to_char = np.repeat(np.arange(len(text)), [len(c.encode("utf-8", "surrogatepass")) for c in text]) if text else np.empty(0, int)
        end = np.cumsum(self.sizes[np.frombuffer(ids, "<u4")])
        start = end - self.sizes[np.frombuffer(ids, "<u4")]
        return [(int(to_char[s]), int(to_char[e - 1]) + 1) for s, e in zip(start, end, strict=True)]


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def encode_decode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded", offsets: str | None = None) -> DataFrame:
    """df with the columns `ids` (binary, little-endian unsigned 32-bit), n_<ids> (long), `decoded`
    (binary; None: not made) and, if named, `offsets` (array of start, end in characters).

    A null or empty text has no ids. Very long texts are encoded whole. All rows, repeated ones too,
    and all other columns are kept; a column of an added name is replaced. No shuffle."""
    small_batches(df.sparkSession)
    added = [(ids, "binary"), (f"n_{ids}", "long")] + [(decoded, "binary")] * bool(decoded) + [(offsets, "array<struct<start:int,end:int>>")] * bool(offsets)
    rest = df.drop(*[n for n, _ in added])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), *(f"`{n}` {t}" for n, t in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            got = c.encode(texts)
            new = [pa.array(got, pa.binary()), pa.array([len(g) // 4 for g in got], pa.int64())]
            if decoded:
                new.append(pa.array([c.decode(g) for g in got], pa.binary()))
            if offsets:
                new.append(pa.array([[{"start": s, "end": e} for s, e in c.char_offsets(t or "", g)] for t, g in zip(texts, got, strict=True)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(n for n, _ in added)])
        c.kept.clear()  # the worker may do other work next
        release()

    return rest.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the bytes that its ids stand for; null ids give empty bytes."""
    rest = df.drop(decoded)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), f"`{decoded}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            got = [c.decode(x) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=[*batch.schema.names, decoded])

    return rest.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's whole text."""
    done = encode_decode(df.select("doc_id", "text"), path, pattern).drop("text")
    return done.select("doc_id", F.col("n_ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
