"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

The short sets are sketched and the long ones are asked: an item's sketch is some of its shingles, the rarest, and what counts is how many of them a document has. (Sketches of both sides compare a few hundred hashes
of a long document with an item's few dozen, and find nothing.) Items are partitioned by size, and each size
has its own sketch length, least number of hits and least size of document. A document that holds the wanted
share of an item lacks at most a known number of its shingles, so it cannot lack more of the sketch: asking for
the rest of the sketch misses nothing. Candidates are verified by the exact share of the item's shingles that
the document holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.llm.common import ascii_lower, broadcast_if_small, pinned, saved, text_key, text_of, words

WIDTH, SHARE, SPARE = 5, 0.8, 3
#: So many sketch rows, of 80 bytes each at most, are broadcast at most; so many keys of 24 bytes.
SKETCH_ROWS, KEY_ROWS = 500_000, 500_000


def shingles(tokens: Column, width: int | Column) -> Column:
    """All runs of `width` words, each as one string; none if there are fewer words."""
    starts = F.when(F.size(tokens) >= width, F.sequence(F.lit(1), F.size(tokens) - width + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, width), " "))


def _hashes(tokens: Column, width: int) -> Column:
    """The hashes of all distinct runs of `width` words."""
    starts = F.when(F.size(tokens) >= width, F.sequence(F.lit(0), F.size(tokens) - width)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*(F.get(tokens, i + k) for k in range(width)))))


def _words(text: str = "text") -> Column:
    return words(ascii_lower(text_of(text)))


def _item_key(tokens: Column) -> Column:
    return text_key(F.array_join(tokens, " "))


def _items(items: DataFrame, width: int, share: float) -> DataFrame:
    """One row for each different item: key, width (less than asked for if it has fewer words), shingles, size and what may lack."""
    made = items.select(_words().alias("w")).filter(F.size("w") > 0).select(_item_key(F.col("w")).alias("item"), "w").dropDuplicates(["item"])
    made = made.withColumn("width", F.least(F.size("w"), F.lit(width)))
    made = made.withColumn("shingles", F.array_distinct(shingles(F.col("w"), F.col("width"))))
    spare = F.floor(F.size("shingles") * F.lit(1 - share) + F.lit(1e-9)).cast("int")
    return made.select("item", "width", "shingles", F.size("shingles").alias("n"), spare.alias("may_lack"))


def _sketches(items: DataFrame) -> DataFrame:
    """One row for each shingle in an item's sketch, enough of them for the item's size.

    Any shingles would do; those that the fewest items hold are taken, and of these the ones with the smallest
    hashes, so that a stock phrase of many items is asked for only where there is nothing else.
    """
    each = items.select("item", "width", "n", "may_lack", F.explode("shingles").alias("s"))
    common = each.groupBy("s").agg(F.count("*").alias("holders"))
    place = F.row_number().over(W.partitionBy("item").orderBy("holders", F.xxhash64(F.xxhash64("s")), "s"))
    length = F.least("n", F.col("may_lack") + 1 + SPARE)
    kept = each.join(common, "s").withColumn("place", place).filter(F.col("place") <= length)
    return kept.select("item", "width", "n", (length - F.col("may_lack")).alias("need"), F.split("s", " ").alias("w"))


def found_in(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """text (a key of the whole text), item (a key of its words), hits, size: the items that each different text of docs contains."""
    items = saved(_items(items, width, share))
    widths = sorted(r[0] for r in items.select("width").distinct().limit(width).collect())
    texts = docs.select(text_of("text").alias("text"))
    sketch, found = _sketches(items), None
    for k in widths:  # one for nearly all benchmarks, `width` at most
        probe = sketch.filter(F.col("width") == k).select("item", "n", "need", F.xxhash64(*(F.get("w", F.lit(i)) for i in range(k))).alias("h"))
        read = pinned(texts.select(text_key(F.col("text")).alias("key"), "text"), "w", _words())
        each = read.select("key", _hashes(F.col("w"), k).alias("hs"))
        # outer: for a plain explode Spark adds a filter on the array, which would build the array twice
        each = each.select("key", F.size("hs").alias("has"), F.explode_outer("hs").alias("h"))
        hits = each.join(broadcast_if_small(probe, SKETCH_ROWS), "h").filter(F.col("has") >= F.col("n") * F.lit(share) - F.lit(1e-9))
        hits = hits.groupBy("key", "item").agg(F.size(F.collect_set("h")).alias("hit"), F.max("need").alias("need")).filter("hit >= need")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], "text struct<k1:bigint,k2:bigint>, item struct<k1:bigint,k2:bigint>, hits int, size int")
    found = saved(found.select("key", "item"))
    # verified row by row: a text may hold any number of items, of any length
    wanted = found.join(items.select("item", "width", F.col("n").alias("size"), F.explode("shingles").alias("shingle")), "item")
    few = broadcast_if_small(found.select(F.col("key").alias("few")).distinct(), KEY_ROWS)
    asked = texts.join(few, text_key(texts["text"]) == few["few"], "left_semi").select(text_key(F.col("text")).alias("key"), "text").dropDuplicates(["key"])
    split = pinned(asked, "w", _words())
    held = None
    for k in widths:
        own = split.select("key", F.lit(k).alias("width"), F.explode_outer(F.array_distinct(shingles(F.col("w"), k))).alias("shingle"))
        held = own if held is None else held.unionByName(own)
    counted = wanted.join(held, ["key", "width", "shingle"]).groupBy("key", "item", "size").agg(F.count("*").cast("int").alias("hits"))
    return saved(counted.filter(F.col("hits") >= F.col("size") * F.lit(share) - F.lit(1e-9)).select(F.col("key").alias("text"), "item", "hits", "size"))


def contained(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row for each document and item that it contains: doc_id, item_id, hits, size, containment.

    An item is contained if at least `share` (0.8) of its distinct shingles of `width` (5) words occur in the
    document; A to Z are lower-cased. Items of fewer words are one shingle, which must occur; items without words
    are never contained. Null texts are empty. Rows are judged each by its own text, of any length; different
    texts once. Items alike, with equal or null ids too, are reported each by its id, and rows alike once.
    Ids may be of any type. Empty tables give an empty result; other columns are ignored.
    """
    found = found_in(docs, items, **options)
    ids = items.select("item_id", _words().alias("w")).filter(F.size("w") > 0).select("item_id", _item_key(F.col("w")).alias("item"))
    out = docs.select("doc_id", text_key(text_of("text")).alias("text")).join(found, "text").join(ids, "item")
    return out.select("doc_id", "item_id", "hits", "size", F.round(F.col("hits") / F.col("size"), 6).alias("containment")).distinct()


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that contain no item (see `contained`), unchanged; their columns may have any names."""
    bad = broadcast_if_small(found_in(docs, items, **options).select(F.col("text").alias("bad")).distinct(), KEY_ROWS)
    return docs.join(bad, text_key(text_of(docs["text"])) == bad["bad"], "left_anti")
