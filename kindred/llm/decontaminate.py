"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The index is a stored table of postings (row, term, position) of the training texts, kept for the
terms of the test items: no other term can be part of a match. Each window of an item looks up its
rarest term's postings, shifts them by the term's offset in the item and intersects them with those
of the second rarest; what is left (row, item, offset) is intersected with the postings of all other
terms of its windows. Windows that are complete are exact phrase matches.

Words: A-Z lower-cased, then runs of characters other than \\x00-\\x2F, \\x3A-\\x60 and \\x7B-\\x7F."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored

#: Ids or terms (some 16 bytes each) up to which a side is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands after the last word of every text in the index; it can't be a word.
END = "\x00"


def split_words(text: str | Column) -> Column:
    """The words with, where the text begins or ends with separators, an empty string there."""
    return F.split(F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), SEPARATORS)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df to be broadcast if its counted rows are few, else to be merged after a shuffle."""
    return df.hint("broadcast" if rows <= BROADCAST_ROWS else "merge")


def item_words(items: DataFrame, window: int) -> DataFrame:
    """item, item_id, words, size (words of a window) of each different item that has words."""
    words = F.filter(split_words("text"), lambda w: w != "")
    return (items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words.alias("words")).where(F.size("words") > 0).distinct()
            .select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words", F.least(F.size("words"), F.lit(window)).alias("size")))


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The stored postings of docs(doc_id, text) for the words of vocabulary(word): rid (a hash of id and
    text, so that equal rows share postings), doc_id, term (a hash of the word), pos. One scan, no shuffle
    (with a vocabulary beyond BROADCAST_ROWS, one of the postings). A row of END gives every row's length."""
    n = vocabulary.count()
    words = vocabulary.select("word").union(docs.sparkSession.createDataFrame([(END,)], "word string"))
    cut = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), split_words("text").alias("w"))
    # only the ends of a split can be empty
    cut = cut.select("doc_id", "rid", (F.col("w")[0] == "").cast("int").alias("lead"), F.concat(F.when(F.element_at("w", -1) == "", F.slice("w", 1, F.size("w") - 1)).otherwise(F.col("w")), F.array(F.lit(END))).alias("w"))
    cut = cut.select("doc_id", "rid", F.when(F.size("w") > 1, F.col("lead")).otherwise(0).alias("lead"), F.posexplode("w").alias("at", "word"))
    postings = cut.join(_small(words, n), "word").select("rid", "doc_id", F.xxhash64("word").alias("term"), (F.col("at") - F.col("lead")).alias("pos"))
    return stored(postings, "postings")


def phrase_matches(index: DataFrame, items: DataFrame) -> DataFrame:
    """rid, item_id, size, at (position of the item's first word in the text), starts (in the item, of the
    windows that occur there): exact matches of windows of items, as item_words() gives them."""
    end = F.xxhash64(F.lit(END))
    items = stored(items.withColumn("terms", F.transform("words", lambda w: F.xxhash64(w))).drop("words"), "items")
    counts = index.where(F.col("term") != end).groupBy("term").count()
    at = items.select("item", "size", F.size("terms").alias("n"), F.posexplode("terms").alias("ipos", "term"))
    # a term that no text has can be in no match: its windows go with the inner join
    at = stored(at.join(counts.hint("merge"), "term"), "terms")
    starts = F.sequence(F.greatest(F.lit(0), F.col("ipos") - F.col("size") + 1), F.least(F.col("ipos"), F.col("n") - F.col("size")))
    windows = (at.select("item", "size", "ipos", "term", "count", F.explode(starts).alias("s"))
               .groupBy("item", "size", "s").agg(F.array_sort(F.collect_list(F.struct("count", "ipos", "term"))).alias("t")).where(F.size("t") == F.col("size")))
    anchors = stored(windows.select("item", F.col("t")[0].alias("a"), F.element_at("t", F.least(F.lit(2), F.size("t"))).alias("b"), "s", (F.col("s") + F.col("size") - 1).alias("e"))
                     .groupBy("item", "a", "b").agg(F.min("s").alias("lo"), F.max("s").alias("last"), F.max("e").alias("hi")), "anchors")
    n = anchors.count()
    first = index.withColumnRenamed("term", "term_a").join(_small(anchors.withColumn("term_a", F.col("a.term")), n), "term_a")
    # a text may begin within the item: only where the last window would begin before the text is there no match
    first = first.select("rid", "item", (F.col("pos") - F.col("a.ipos")).alias("at"), F.col("b.term").alias("term"), (F.col("pos") - F.col("a.ipos") + F.col("b.ipos")).alias("pos"), "lo", "hi", "last").where(F.col("at") + F.col("last") >= 0)
    second = index.select("rid", "term", "pos").join(_small(anchors.select(F.col("b.term").alias("term")).distinct(), n), "term", "left_semi")
    found = stored(first.join(second.hint("merge"), ["rid", "term", "pos"]).groupBy("rid", "item", "at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "found")
    # all other terms of the windows that are left
    rows = found.select("rid").distinct()
    rest = index.where(F.col("term") != end).select("rid", "term", "pos").join(_small(rows, rows.count()), "rid", "left_semi")
    need = found.join(_small(items.select("item", "terms"), items.count()), "item")
    need = need.select("rid", "item", "at", "lo", F.posexplode(F.slice("terms", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1)).alias("k", "term"))
    need = need.select("rid", "item", "at", (F.col("lo") + F.col("k")).alias("ipos"), "term", (F.col("at") + F.col("lo") + F.col("k")).alias("pos"))
    met = need.join(rest.hint("merge"), ["rid", "pos", "term"]).groupBy("rid", "item", "at").agg(F.array_sort(F.collect_set("ipos")).alias("m"))
    met = met.join(_small(items.select("item", "item_id", "size"), n), "item")
    # in a sorted array of distinct positions, size of them in a row are a window
    whole = F.filter(F.col("m"), lambda x, i: F.get(F.col("m"), i + F.col("size") - 1) == x + F.col("size") - 1)
    return met.select("rid", "item_id", "size", "at", whole.alias("starts")).where(F.size("starts") > 0)


def proximity_matches(index: DataFrame, items: DataFrame, span: int) -> DataFrame:
    """rid, item_id, near (position of the item's rarest word): places where all different words of an
    item lie, in any order, at most `span` words from its rarest one. Postings meet by row and by
    stretches of `span` words, each place looking in its own stretch and the two beside it."""
    end = F.xxhash64(F.lit(END))
    words = items.select("item", "item_id", F.explode(F.array_distinct("words")).alias("word")).select("item", "item_id", F.xxhash64("word").alias("term"))
    counts = index.where(F.col("term") != end).groupBy("term").count()
    known = stored(words.join(counts.hint("merge"), "term", "left"), "near")
    rare = known.groupBy("item", "item_id").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "term")).alias("r"), F.count("*").alias("n")).where("r.count > 0")
    n = known.count()
    place = index.select("rid", "pos", F.col("term").alias("t")).join(_small(rare.select("item", "item_id", "n", F.col("r.term").alias("t")), n), "t")
    place = place.select("rid", "item", "item_id", "n", F.col("pos").alias("near"), F.explode(F.array(*[F.floor(F.col("pos") / span) + k for k in (-1, 0, 1)])).alias("stretch"))
    others = index.join(_small(known.select("item", "term").distinct(), n), "term").select("rid", "item", "term", "pos", F.floor(F.col("pos") / span).alias("stretch"))
    met = place.join(others.hint("merge"), ["rid", "item", "stretch"]).where(F.abs(F.col("pos") - F.col("near")) <= span)
    return met.groupBy("rid", "item", "item_id", "n", "near").agg(F.count_distinct("term").alias("got")).where("got = n").select("rid", "item_id", "near")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """For every row of docs(doc_id, text): doc_id, n_words, n_hit (words inside an occurring window),
    n_items, items_sha256, contaminated, and row_key (a hash of id and text).

    A null or empty text has no words. Rows of equal id and text get equal results, each its own row;
    rows of one id and different texts are told apart. Items without words are never met; a null item
    id reads as ''. Either table may be empty."""
    listed = stored(item_words(items, window), "listed")
    index = build_index(docs, listed.select(F.explode("words").alias("word")).distinct())
    hits = stored(phrase_matches(index, listed), "hits")
    covered = F.flatten(F.transform("starts", lambda s: F.sequence(F.col("at") + s, F.col("at") + s + F.col("size") - 1)))
    words = hits.select("rid", F.explode(F.array_distinct(covered)).alias("pos")).distinct().groupBy("rid").agg(F.count("*").alias("n_hit"))
    names = hits.select("rid", "item_id").distinct().groupBy("rid").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    rows = index.where(F.col("term") == F.xxhash64(F.lit(END))).select("doc_id", "rid", F.col("pos").cast("long").alias("n_words"))
    met = words.join(names.hint("merge"), "rid")
    out = rows.join(met.hint("merge"), "rid", "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), F.col("rid").alias("row_key"))
