"""Token ids in files of fixed bit width.

A file: 8 bytes magic, a little-endian unsigned 32-bit length and so many bytes of JSON (bits,
n_docs, n_tokens, block, crc32 of the payload), then little-endian arrays: document ids (int64),
1 where the id is null (uint8), each document's end in ids (int64), byte offsets of the blocks and of
the end (uint64), and the payload. A block holds `block` ids of `bits` bits each, most significant
bit first, padded to whole bytes. bits is the least number that holds every id of the vocabulary, so
a block unpacks in a few numpy calls and any range of ids is found by arithmetic on the offsets."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import new_dir, small_batches, stored
from .byte_bpe import byte_table
from ._files import make_dir, read_range, write_whole

MAGIC = b"KTOKENS1"
BLOCK = 1 << 16
#: Ids after which a task starts a new file.
FILE_TOKENS = 1 << 22
#: Words and pieces whose ids a worker keeps, the longest word kept, and pieces merged in one call.
KEPT_WORDS, KEPT_PIECES, KEPT_LENGTH, JOINED = 500_000, 400_000, 48, 500
#: Python's str.split() also splits at these, which are not white space to the tokenizers.
NOT_SPACE = re.compile("[\x1c-\x1f]")
SPACES = re.compile("[\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]+")
#: Characters whose lower case, normal form and class are left to the library.
WIDE = re.compile("[\u0130\u0250-\U0010ffff]")


class WordCoder:
    """Encodes with a tokenizers file. by_word says that no token of it spans or depends on white
    space; words' ids are then kept, and only what was not met before goes to the library.

    Of a file whose normaliser is NFC, white space and lower case and whose words are split by a
    pattern into bytes, new words are split here and only new pieces are merged by the library, many
    in one call; words with characters from U+0250 on, whose classes may differ between engines, are
    left whole to the library. So are texts in which an added token's name stands (in any case): the
    library cuts those off before it looks at words."""

    def __init__(self, path: str, by_word: bool):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.by_word = by_word
        self.kept: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.pattern = self._split_pattern()
        if self.pattern is not None:
            import regex

            self.pattern = regex.compile(self.pattern + "|\n")
            self.merger = Tokenizer.from_file(path)
            self.merger.encode_special_tokens = True
            self.merger.normalizer = normalizers.Sequence([])
            self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            suffix = self.tokenizer.model.end_of_word_suffix or ""
            #: Whether an id ends a piece.
            self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True
            self.to_char = dict(enumerate(byte_table())) | {10: "\n"}

    def _split_pattern(self) -> str | None:
        made = json.loads(self.tokenizer.to_str())
        steps, pre = (made.get("normalizer") or {}).get("normalizers") or [], (made.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if [n.get("type") for n in steps] != ["NFC", "Replace", "Lowercase"] or [p.get("type") for p in pre] != ["Split", "ByteLevel"]:
            return None
        if steps[1].get("pattern") != {"Regex": "\\s+"} or not pre[0].get("invert") or pre[0].get("behavior") != "Removed" or pre[1].get("use_regex") or pre[1].get("add_prefix_space"):
            return None
        return pre[0]["pattern"].get("Regex") if made["model"].get("end_of_word_suffix") else None

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers; a null or empty text has none."""
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        if len(self.pieces) > KEPT_PIECES:
            self.pieces.clear()
        whole = {i for i, t in enumerate(texts) if t and self.added is not None and self.added.search(t)}
        cut = [[] if not t or i in whole else [w for w in SPACES.split(t) if w] if NOT_SPACE.search(t) else t.split() for i, t in enumerate(texts)]
        new: set[str] = set()
        for words in cut:
            new.update(filterfalse(self.kept.__contains__, words))
        self._add(new)
        out = [b"".join(map(self.kept.__getitem__, words)) for words in cut]
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        for w in (w for w in new if len(w) > KEPT_LENGTH):
            del self.kept[w]
        return out

    def _add(self, new: set[str]) -> None:
        if self.pattern is None:
            for w in new:
                self.kept[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
            return
        wide = [w for w in new if WIDE.search(w)] if WIDE.search("\n".join(new)) else []
        for w, e in zip(wide, self.tokenizer.encode_batch_fast(wide, add_special_tokens=False), strict=True):
            self.kept[w] = np.array(e.ids, "<u4").tobytes()
        plain = new.difference(wide) if wide else new
        letters = list(filter(str.isalpha, plain))  # one piece each
        low = "\n".join(letters).lower().split("\n")
        self._merge(set(low))
        self.kept.update(zip(letters, map(self.pieces.get, low), strict=False))
        rest = list(filterfalse(str.isalpha, plain))
        self._split(rest, "\n".join(rest).lower())

    def _split(self, words: list[str], text: str) -> None:
        """Keep the ids of words, whose normalised forms are the lines of text."""
        if not words:
            return
        parts = self.pattern.findall(text)
        self._merge(set(parts))
        at, got = 0, []
        for p in parts:
            if p == "\n":
                self.kept[words[at]] = got[0] if len(got) == 1 else b"".join(got)
                at, got = at + 1, []
            else:
                got.append(self.pieces[p])
        self.kept[words[at]] = b"".join(got)

    def _merge(self, every: set[str]) -> None:
        """Keep the ids of pieces."""
        pieces = list(every.difference(self.pieces, ("\n", "")))
        for i in range(0, len(pieces), 20_000):
            part = pieces[i : i + 20_000]
            groups = [part[k : k + JOINED] for k in range(0, len(part), JOINED)]
            mapped = ["\n".join(g).encode().decode("latin-1").translate(self.to_char) for g in groups]
            for group, e in zip(groups, self.merger.encode_batch_fast(mapped, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                raw, at = ids.tobytes(), 0
                for p, to in zip(group, (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), strict=True):
                    self.pieces[p] = raw[at:to]
                    at = to


@lru_cache(maxsize=2)
def coder(path: str, by_word: bool) -> WordCoder:
    return WordCoder(path, by_word)


@lru_cache(maxsize=2)
def vocabulary_bits(path: str) -> int:
    from tokenizers import Tokenizer

    return max(1, (Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, the last byte padded with zeros."""
    raw = np.ascontiguousarray(ids.astype(">u4")).view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return raw[:, 4 - bits // 8 :].tobytes()
    return np.packbits(np.unpackbits(raw, axis=1)[:, 32 - bits :]).tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros((n, 4), np.uint8)
    if bits % 8 == 0:
        out[:, 4 - bits // 8 :] = raw[: n * bits // 8].reshape(n, bits // 8)
    else:
        wide = np.zeros((n, 32), np.uint8)
        wide[:, 32 - bits :] = np.unpackbits(raw, count=n * bits).reshape(n, bits)
        out = np.packbits(wide, axis=1)
    return out.view(">u4").ravel().astype("<u4")


def file_bytes(doc_ids: list[int | None], ids: list[bytes], bits: int, block: int = BLOCK) -> bytes:
    """A whole file of these documents."""
    every = np.frombuffer(b"".join(ids), "<u4")
    if len(every) and int(every.max()).bit_length() > bits:
        raise ValueError("an id does not fit the width")
    blocks = [pack(every[i : i + block], bits) for i in range(0, len(every), block)]
    payload = b"".join(blocks)
    head = json.dumps({"bits": bits, "n_docs": len(doc_ids), "n_tokens": len(every), "block": block, "crc32": zlib.crc32(payload)}).encode()
    return b"".join([
        MAGIC, struct.pack("<I", len(head)), head,
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.cumsum([len(x) // 4 for x in ids], dtype="<i8").tobytes(),
        np.cumsum([0, *map(len, blocks)], dtype="<u8").tobytes(), payload,
    ])


class TokenFile:
    """Reads a file: ids(i, j) touches only the blocks that hold ids i to j."""

    def __init__(self, uri: str):
        self.uri = uri
        magic, n = struct.unpack("<8sI", read_range(uri, 0, 12))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        self.head = h = json.loads(read_range(uri, 12, n))
        at, docs, blocks = 12 + n, h["n_docs"], -(-h["n_tokens"] // h["block"])
        raw = read_range(uri, at, docs * 17 + (blocks + 1) * 8)
        self.doc_ids = np.frombuffer(raw, "<i8", docs)
        self.is_null = np.frombuffer(raw, np.uint8, docs, docs * 8).astype(bool)
        self.ends = np.frombuffer(raw, "<i8", docs, docs * 9)
        self.blocks = np.frombuffer(raw, "<u8", blocks + 1, docs * 17)
        self.payload = at + len(raw)

    def ids(self, i: int, j: int) -> np.ndarray:
        if j <= i:
            return np.empty(0, "<u4")
        size = self.head["block"]
        a, b = i // size, (j - 1) // size
        data = read_range(self.uri, self.payload + int(self.blocks[a]), int(self.blocks[b + 1] - self.blocks[a]))
        got = []
        for k in range(a, b + 1):
            n = min(size, self.head["n_tokens"] - k * size)
            lo = int(self.blocks[k] - self.blocks[a])
            got.append(unpack(data[lo : lo + int(self.blocks[k + 1] - self.blocks[k])], self.head["bits"], n))
        return np.concatenate(got)[i - a * size : j - a * size]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write(df: DataFrame, path: str, out_dir: str | None = None, end_id: int | None = None, by_word: bool = False, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode df(doc_id, text) with the tokenizers file at `path` and write the ids in ascending doc_id
    order. Returns the manifest, a stored table: file, part, seq, n_docs, n_tokens.

    One range shuffle of the texts; a task encodes and writes its range, so ids never move. A null or
    empty text gives end_id alone (nothing without one). Null ids come first, rows of the same id
    stay together in the order of their texts' hashes. An empty table gives an empty manifest."""
    spark = df.sparkSession
    small_batches(spark)
    out_dir = out_dir or new_dir(spark, "tokens")
    bits = vocabulary_bits(path)
    if end_id is not None:
        bits = max(bits, end_id.bit_length())
    make_dir(out_dir)
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, done = TaskContext.get().partitionId(), 0, [], []

        def flush() -> None:
            nonlocal seq, held
            name = f"{out_dir}/part-{part:06d}-{seq:05d}.tok"
            write_whole(name, file_bytes([d for d, _ in held], [x for _, x in held], bits))
            done.append({"file": name, "part": part, "seq": seq, "n_docs": len(held), "n_tokens": sum(len(x) for _, x in held) // 4})
            seq, held = seq + 1, []

        size = 0
        for batch in batches:
            ids = coder(path, by_word).encode(batch.column(1).to_pylist())
            for d, x in zip(batch.column(0).to_pylist(), ids, strict=True):
                held.append((d, x + end))
                size += len(x) // 4 + 1
                if size >= file_tokens:
                    flush()
                    size = 0
        if held:
            flush()
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("file", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stored(rows.mapInArrow(run, "file string, part int, seq int, n_docs long, n_tokens long"), "manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids before it in all files), n_tokens, ids (binary) of the files of a manifest."""
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = manifest.select("file", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("before"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                f = TokenFile(row["file"])
                first = 0
                while first < len(f.ends):  # some MB of ids at a time
                    at = int(f.ends[first - 1]) if first else 0
                    last = max(first + 1, int(np.searchsorted(f.ends, at + (1 << 20), "right")))
                    ids, base = f.ids(at, int(f.ends[last - 1])), at
                    cuts = [at, *f.ends[first:last].tolist()]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([None if z else d for d, z in zip(f.doc_ids[first:last].tolist(), f.is_null[first:last], strict=True)], pa.int64()),
                        pa.array([row["before"] + c for c in cuts[:-1]], pa.int64()),
                        pa.array([b - a for a, b in zip(cuts, cuts[1:], strict=False)], pa.int64()),
                        pa.array([ids[a - base : b - base].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                    ], schema=schema)
                    first = last

    return files.repartition(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def written_and_read(df: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, all as the files have them."""
    back = read(df.sparkSession, write(df, path, end_id=end_id, by_word=True))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
