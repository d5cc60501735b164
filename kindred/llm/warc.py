"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by page id. The ranges are drawn from exact sums of payload bytes over
buckets of the id, not from a sample, so they and the files depend on the pages alone: not on
partitions, batches or which task writes. A range is written as files of gzip members, a record
each; a new file starts with a range and once the compressed size is reached. Headers and digests are made anew
from the payload. Of equal payloads the one with the smallest page id is a response, the others are
revisits of it. Files appear by rename from temporary names; the manifest, a table written when all
are there, lists what belongs to the archive. The same input gives the same bytes."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import new_dir, small_batches, stored
from ._files import make_dir, store, write_whole

FILE_BYTES = 32 << 20
#: Payload bytes of a range: this share of all, within these bounds; and buckets of the id (as a power of two) in which
#: they are summed at a time.
RANGES, RANGE_BYTES, BUCKET_BITS = 256, (8 << 20, 512 << 20), 16
#: Partitions at most that ranges are dealt to.
PARTITIONS = 20_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = b"\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, turn: int = 0) -> str:
    """A URN that holds the page id and which of its rows the record is (a UUID of version 8)."""
    v = (page_id or 0) & (1 << 64) - 1
    b = v >> 62 | (4 if page_id is None else 0)
    return f"<urn:uuid:{uuid.UUID(int=turn << 80 | 8 << 76 | b << 64 | 2 << 62 | v & (1 << 62) - 1)}>"


def page_of(urn: str) -> int | None:
    i = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    if i >> 66 & 1:
        return None
    v = (i >> 64 & 3) << 62 | i & (1 << 62) - 1
    return v - (1 << 64) if v >> 63 else v


def _clean(value: str) -> str:
    """A header's value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def member(fields: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in [*fields, ("WARC-Block-Digest", "sha1:" + base32_sha1(block)), ("Content-Length", str(len(block)))])
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode("utf-8", "surrogatepass") + EOL + block + EOL + EOL) + z.flush()


def page_member(page_id: int | None, turn: int, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, turn)), ("WARC-Date", date), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)), ("Content-Type", "application/http; msgtype=response")]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    else:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("WARC-Refers-To-Target-URI", refers_url or "")]
    return member(fields, block)


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, refers_to, refers_url of the rows (null ids left out) whose payload, of at least
    least_bytes, a row with a smaller id has too. Payloads are told apart by SHA-256 and never move."""
    html = F.coalesce(F.col("html"), F.lit(""))
    keys = stored(pages.where(F.col("page_id").isNotNull() & (F.octet_length(html) >= least_bytes)).select(F.col("page_id").cast("long").alias("page_id"), "url", F.sha2(html, 256).alias("digest")), "digests")
    # written, so that the join has plain inputs, which adaptive execution can split where a payload is hot
    first = stored(keys.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("f"), F.count("*").alias("n")).where("n > 1"), "first")
    again = keys.select("page_id", "digest").join(first.hint("merge"), "digest").where(F.col("page_id") != F.col("f.page_id"))
    return again.select("page_id", "digest", F.col("f.page_id").alias("refers_to"), F.col("f.url").alias("refers_url"))


def range_starts(pages: DataFrame) -> np.ndarray:
    """The first ids of all ranges but the first. Bytes are summed by the highest bits of the id, buckets that hold
    more than a range again by the next bits, and consecutive buckets make a range until it would be too large. At
    most 2**BUCKET_BITS sums for each of a few buckets reach the driver; one id is never divided."""
    rows = pages.select(F.col("page_id").cast("long").alias("id"), (F.octet_length(F.coalesce("html", F.lit(""))) + 300).alias("n")).where("id IS NOT NULL")
    whole = rows.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum("n").alias("n")).first()
    if whole.n is None:
        return np.empty(0, np.int64)
    most = min(max(whole.n // RANGES, RANGE_BYTES[0]), RANGE_BYTES[1])
    shift = 0
    while (whole.hi >> shift) - (whole.lo >> shift) >= 1 << BUCKET_BITS:
        shift += 1
    cells, some = [], rows
    while True:
        sums = some.groupBy(F.shiftright("id", shift).alias("b")).agg(F.sum("n").alias("n")).toArrow().to_pylist()
        heavy = [r["b"] for r in sums if r["n"] > most] if shift else []
        again = set(heavy)
        cells += [(r["b"] << shift, r["n"]) for r in sums if r["b"] not in again]
        if not heavy:
            break
        some = rows.where(F.shiftright("id", shift).isin(heavy))
        shift = max(0, shift - BUCKET_BITS)
    starts, held = [], 0
    for at, n in sorted(cells):
        if held and held + n > most:
            starts.append(at)
            held = 0
        held += n
    return np.array(starts, np.int64)


def write(pages: DataFrame, out_dir: str | None = None, file_bytes: int = FILE_BYTES, least_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Write pages(page_id, url, html) and return the manifest, a stored table: file, part, seq,
    n_records, n_bytes, sha1 (hex, of the file).

    A null html is an empty payload, a null url an empty one. Null ids come first, as responses. Rows of
    one id keep the order of their hashes; a later one with the same payload revisits its own id. One
    range shuffle of the payloads; the marks of revisits travel in the same shuffle. An empty table
    gives an empty manifest."""
    spark = pages.sparkSession
    small_batches(spark, 200)
    out_dir = out_dir or new_dir(spark, "warc")
    make_dir(out_dir)
    marks = revisits(pages, least_bytes).select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "refers_to", "refers_url")
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit(1).alias("kind"), "url", F.encode(payload, "UTF-8").alias("payload"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"))
    starts = range_starts(pages)
    ranges = len(starts) + 1
    parts = min(ranges, PARTITIONS)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, ids.to_numpy(), "right").astype(np.int32))

    # null ids stand before all others
    place = range_of(F.coalesce("page_id", F.lit(-(2**63)).cast("long")))
    all_rows = rows.unionByName(marks).withColumn("range", place)
    sorted_rows = all_rows.repartitionById(parts, F.floor(F.col("range").cast("long") * parts / ranges).cast("int")).sortWithinPartitions("range", "page_id", "kind", F.xxhash64("url", "payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, done, held, size, n = 0, 0, [], [], 0, 0
        here: object = ...
        marked: dict[str, tuple[int, str | None]] = {}
        own: set[str] = set()
        turn = 0

        def flush() -> None:
            nonlocal held, size, n, seq
            name = f"{out_dir}/part-{part:06d}-{seq:05d}.warc.gz"
            data = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, part << 16 | seq)), ("WARC-Date", date), ("WARC-Filename", name.rpartition("/")[2]), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n") + b"".join(held)
            write_whole(name, data)
            done.append({"file": name, "part": part, "seq": seq, "n_records": n, "n_bytes": len(data), "sha1": hashlib.sha1(data).hexdigest()})
            held, size, n, seq = [], 0, 0, seq + 1

        for batch in batches:
            for page_id, kind, url, data, digest, to, to_url, into in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if into != part:
                    if held:
                        flush()
                    part, seq = into, 0
                if here is ... or page_id != here:
                    here, marked, own, turn = page_id, {}, set(), 0
                if kind == 0:
                    marked[digest] = (to, to_url)
                    continue
                key = hashlib.sha256(data).hexdigest() if page_id is not None and (marked or turn) else None
                ref, ref_url = marked.get(key, (None, None))
                if ref is None and key in own and len(data) >= least_bytes:
                    ref, ref_url = page_id, url
                if page_id is not None:
                    own.add(key or hashlib.sha256(data).hexdigest())
                held.append(page_member(page_id, turn, url, data, ref, ref_url, date))
                turn, size, n = turn + 1, size + len(held[-1]), n + 1
                if size >= file_bytes:
                    flush()
        if held:
            flush()
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("file", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha1", pa.string())]))

    return stored(sorted_rows.mapInArrow(run, "file string, part int, seq int, n_records long, n_bytes long, sha1 string"), "manifest")


def records(uri: str, step: int = 1 << 16) -> Iterator[bytes]:
    """The records of a file, read and unpacked piece by piece; a file that ends inside one raises."""
    at, path = store(uri)
    with at.open_input_stream(path, compression=None) as f:
        z, got = zlib.decompressobj(31), []
        while data := f.read(step):
            while data:
                got.append(z.decompress(data))
                data = z.unused_data
                if z.eof:
                    yield b"".join(got)
                    z, got = zlib.decompressobj(31), []
        if got:
            raise ValueError(f"cut off within a record: {uri}")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block; digest and lengths are checked."""
    head, _, rest = record.partition(EOL + EOL)
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if not lines[0].startswith("WARC/") or rest[len(block) :] != EOL + EOL or fields.get("warc-block-digest", "sha1:" + base32_sha1(block)) != "sha1:" + base32_sha1(block):
        raise ValueError("a damaged record")
    return fields, block


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """page_id, url, record_type, payload (null for revisits), payload_bytes, payload_digest, refers_to of
    every page record of the manifest's files. A response's digest is checked against its payload."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, size = [], 0
                for fields, block in map(parse, records(uri)):
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    head, _, body = block.partition(EOL + EOL)
                    length = next(int(x.partition(b":")[2]) for x in head.split(EOL) if x.lower().startswith(b"content-length:"))
                    is_new = fields["warc-type"] == "response"
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if is_new and (len(body) != length or base32_sha1(body) != digest):
                        raise ValueError(f"a payload that is not its digest's in {uri}")
                    rows.append({"page_id": page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri", ""), "record_type": fields["warc-type"], "payload": body if is_new else None, "payload_bytes": length, "payload_digest": digest, "refers_to": None if is_new else page_of(fields["warc-refers-to"])})
                    size += len(body)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return manifest.select("file").repartition(n, "file").mapInArrow(run, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def written_and_read(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as the archives have them."""
    return read(pages.sparkSession, write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
