"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Every text is searched for candidates of four kinds. The values' hashes are counted over the corpus
by distinct owners and (repository, owner) pairs. A value that more than MAX_OWNERS owners have is a
widely copied example; the rest are owner-specific and look live. Of kind `opaque` (long mixed
strings, too many to report by their looks) only the owner-specific ones become spans.

The work is linear in a text's matches: a pattern gives the pieces between its matches and the matches,
whose lengths are summed by a window; overlaps are told by running ends and starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import new_name, stored
from .decontaminate import BROADCAST_ROWS

#: Kind, pattern, group of the value, its least length. `+` is kept where a short match takes text
#: away from later ones; for the runs, asking for the length at once finds the same spans.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("opaque", r"[A-Za-z0-9_+/-]{20,}", 0, 20),
]
BASE = ["assign", "access", "hex"]
MAX_OWNERS = 2


def _found(text: Column, at: int) -> Column:
    """All matches of KINDS[at]: array of kind (its index), i (its number), gap (characters since the match
    before), size, ok (whether it is a candidate), hash (of the value)."""
    kind, pattern, group, least = KINDS[at]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    # after the last match there is a piece more
    each = F.arrays_zip(F.split(text, pattern, -1), whole, value).cast("array<struct<piece:string,whole:string,value:string>>")
    ok = lambda v: F.length(v) >= least if kind != "opaque" else v.rlike("[0-9]") & v.rlike("[A-Za-z]")  # noqa: E731  opaque: digits and letters
    out = F.transform(F.filter(each, lambda x: x["whole"].isNotNull()), lambda x, i: F.struct(
        F.lit(at).alias("kind"), i.alias("i"), F.length(x["piece"]).alias("gap"), F.length(x["whole"]).alias("size"), ok(x["value"]).alias("ok"), F.sha2(x["value"], 256).alias("hash")))
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,ok:boolean,hash:string>>"))


def _row_key(text: str, repo: str, owner: str) -> Column:
    """Tells rows apart: two hashes with different seeds. Equal rows share it."""
    cols = [F.col(repo), F.col(owner).cast("string"), F.col(text)]
    return F.concat(F.hex(F.xxhash64(*cols)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *cols)))


def scan(docs: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """A stored table: row_key, repo, owner, found (as _found gives it, of all kinds) of every row, without texts
    or values."""
    rows = docs.select(_row_key(text, repo, owner).alias("row_key"), F.col(repo).alias("repo"), F.col(owner).cast("string").alias("owner"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return stored(rows.select("row_key", "repo", "owner", F.concat(*[_found(F.col("t"), k) for k in range(len(KINDS))]).alias("found")), "scan")


def candidates(scanned: DataFrame) -> DataFrame:
    """A stored table: row_key, repo, owner, kind, start, end (code points, end exclusive), hash of every candidate,
    once for equal rows. An opaque run that overlaps a base span is left out."""
    each = scanned.select("row_key", "repo", "owner", F.explode("found").alias("f")).select("row_key", "repo", "owner", "f.*")
    each = each.repartition("row_key").dropDuplicates(["row_key", "kind", "i"])
    before = Window.partitionBy("row_key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("start", F.coalesce(F.sum(F.col("gap") + F.col("size")).over(before), F.lit(0)) + F.col("gap")).withColumn("end", F.col("start") + F.col("size")).where("ok")
    # running sums only: a frame up to the last row would be worked out anew for each row
    forth = Window.partitionBy("row_key").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("row_key").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("kind") < len(BASE)
    reach = F.max(F.when(base, F.col("end"))).over(forth)
    follow = F.min(F.when(base, F.col("start"))).over(back)
    each = each.withColumn("reach", reach).withColumn("follow", follow)
    apart = ~F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) & ~F.coalesce(F.col("follow") < F.col("end"), F.lit(False))
    return stored(each.where(base | apart).select("row_key", "repo", "owner", "kind", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "hash"), "candidates")


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repositories of every candidate value. Counts are combined before each shuffle;
    null owners are one owner."""
    each = found.select("owner", "repo", "hash").distinct()
    return each.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def classified(found: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """row_key, kind, start, end, hash, n_owners, live of the spans: base ones, and live opaque ones."""
    # the counts are written, so that the join has plain inputs, which adaptive execution can split for a hot value
    each = found.join(stored(ownership(found), "owners").hint("merge"), "hash").withColumn("live", F.col("n_owners") <= max_owners)
    return each.where((F.col("kind") < len(BASE)) | F.col("live")).select("row_key", "kind", "start", "end", "hash", "n_owners", "live")


def _written(spans: Column) -> Column:
    """kind:start:end of each span (start, kind, end), comma-joined."""
    names = F.array(*[F.lit(k) for k, *_ in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row per row of docs: the repo column, n_assign, n_access, n_hex, base_sha256, spans (written), n_live.

    A null or empty text has no spans. Equal rows get equal results, each its own row; ties in start go
    by kind as listed. An empty table gives an empty result."""
    scanned = scan(docs, text, repo, owner)
    spans = stored(classified(candidates(scanned), max_owners), "classified")
    one, base = F.struct("start", "kind", "end"), F.col("kind") < len(BASE)
    per = spans.groupBy("row_key").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, name in enumerate(BASE)], F.array_sort(F.collect_list(F.when(base, one))).alias("base"), F.array_sort(F.collect_list(one)).alias("kept"), F.count_if("live").alias("n_live"))
    out = scanned.select("row_key", F.col("repo").alias(repo)).join(per.hint("merge"), "row_key", "left")
    empty = lambda c: F.coalesce(_written(F.col(c)), F.lit(""))
    return out.select(F.col(repo), *[F.coalesce(f"n_{name}", F.lit(0)).alias(f"n_{name}") for name in BASE], F.sha2(empty("base"), 256).alias("base_sha256"), empty("kept").alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"))


def redact(docs: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """docs with every live span of the text replaced by [kind]; examples, null texts and all other columns
    stay. Overlapping spans become one. The rows with live spans are broadcast while they are few."""
    live = classified(candidates(scan(docs, text, repo, owner)), max_owners).where("live")
    before = Window.partitionBy("row_key").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    live = live.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0)))
    key, cuts, last, chars = (new_name(docs, c) for c in ("row_key", "cuts", "last", "chars"))
    # a span that begins inside the ones before it only moves their end
    live = live.groupBy(F.col("row_key").alias(key)).agg(F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("from"), F.struct("start", "from", "kind")))).alias(cuts), F.max("end").alias(last))
    live = stored(live, "live")
    side = live.hint("broadcast" if live.count() <= BROADCAST_ROWS // 10 else "merge")
    joined = docs.withColumn(key, _row_key(text, repo, owner)).join(side, key, "left")
    joined = joined.withColumn(chars, F.when(F.col(cuts).isNotNull(), F.encode(text, "UTF-32")))
    # four bytes a character; the mark in front keeps a piece's own first character from being read as one
    piece = lambda at, n: F.decode(F.concat(F.lit(bytearray(b"\x00\x00\xfe\xff")), F.substring(chars, at * 4 + 1, n * 4)), "UTF-32")
    names = F.array(*[F.lit(f"[{k}]") for k, *_ in KINDS])
    cut = F.concat(F.array_join(F.transform(cuts, lambda s: F.concat(piece(s["from"], s["start"] - s["from"]), F.get(names, s["kind"]))), ""), piece(F.col(last), F.length(text)))
    return joined.select(*[F.when(F.col(chars).isNotNull(), cut).otherwise(F.col(text)).alias(c) if c == text else F.col(c) for c in docs.columns])
