"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same fractional number of copies. The whole part is taken; the fractions
are paired, and mass moves at random between the two of a pair until one is 0 or 1. Moves are scaled by the
documents' sizes, so a pair's expected number of copies and its words both stay as they were. In a chunk of a
source each pair is a document, the largest first, and the pool of all smaller ones, whose fractions stay
equal; so what is left at the end is small, where pairs of single documents tend to leave a large one. Each
chunk of a source leaves at most one fraction. These are paired with each other in a tree of further chunks, and
the last one of a source is rounded at random: no document is favoured, and a source misses its target by
less than the last document's words.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.llm.common import WORD, broadcast_if_small, saved, text_of

CHUNK, FAN_IN = 2048, 64
SIDE_ROWS = 100_000
NEAR = 1e-12


def word_count(text: Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def text_id(text: Column) -> Column:
    return F.xxhash64(text)


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights that repeat over the sources in code point order, null last. One row a source.

    Sources are numbered in ranges, each after all sources of the ranges before.
    """
    order = F.col("source").asc_nulls_last()
    dealt = saved(sources.repartitionByRange(max(1, -(-sources.count() // SIDE_ROWS)), order).withColumn("_range", F.spark_partition_id()))
    counts = {r[0]: r[1] for r in dealt.groupBy("_range").count().collect()}  # one for each SIDE_ROWS sources
    before = F.lit(0)
    for p in counts:
        before = F.when(F.col("_range") == p, sum(n for q, n in counts.items() if q < p)).otherwise(before)
    rank = F.row_number().over(W.partitionBy("_range").orderBy(order)) - 1 + before
    return dealt.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (rank % len(cycle) + 1).cast("int")).cast("double")).drop("_range")


def targets(sources: DataFrame, most: float) -> DataFrame:
    """Add target: shares of all words by weight, stopped at `most` times the source's size.

    sources: source, source_size, weight. What a stopped source leaves goes to the others by weight, until
    none is above its stop; each pass stops at least one more source.
    """
    stop = F.col("source_size") * F.lit(most)
    level, stopped = 0.0, -1
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = stop <= F.col("weight") * F.lit(level)
        row = sources.agg(
            F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, stop).otherwise(0.0)).alias("taken"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")
        ).first()
        if row["n"] == stopped or not row["open"]:
            break
        stopped, level = row["n"], (total - row["taken"]) / row["open"]
    return sources.withColumn("target", F.least(stop, F.col("weight") * F.lit(float(level))).cast("double"))


def _pivot(rows: pd.DataFrame) -> pd.DataFrame:
    """Round all fractions of one chunk but at most one."""
    rows = rows.sort_values(["size", "chance", "key"], ascending=False, kind="stable", na_position="last").reset_index(drop=True)
    size, x, chance = (rows[c].to_numpy(copy=True) for c in ("size", "fraction", "chance"))
    at = -1
    for j in range(len(x)):
        if not NEAR < x[j] < 1 - NEAR:
            x[j] = round(x[j])
            continue
        if at < 0:
            at = j
            continue
        a, b = float(size[at]), float(size[j])
        if a == 0 or b == 0:  # no words to move: the empty one is rounded by itself
            zero = at if a == 0 else j
            at = j if zero == at else at
            x[zero] = float(chance[zero] < x[zero])
            continue
        up, down = min(a * (1 - x[at]), b * x[j]), min(a * x[at], b * (1 - x[j]))
        move = up if chance[j] * (up + down) < down else -down
        x[at], x[j] = x[at] + move / a, x[j] - move / b
        for k in (at, j):
            if not NEAR < x[k] < 1 - NEAR:
                x[k] = round(x[k])
        open_ = [k for k in (at, j) if 0 < x[k] < 1]
        at = open_[0] if open_ else -1
    rows["fraction"] = x
    return rows


def _pool(rows: pd.DataFrame) -> pd.DataFrame:
    """Round the equal fractions of one chunk, each document against the pool of those not yet decided."""
    rows = rows.sort_values(["size", "chance", "key"], ascending=False, kind="stable", na_position="last").reset_index(drop=True)
    size, out, chance = (rows[c].to_numpy(copy=True).astype(float) for c in ("size", "fraction", "chance"))
    x, rest = (float(out[0]) if len(out) else 0.0), float(size.sum())
    for j, a in enumerate(size):
        if not NEAR < x < 1 - NEAR:  # the pool is decided
            out[j:] = round(x)
            break
        rest -= a
        if a == 0:  # no words to move
            out[j] = float(chance[j] < x)
        elif rest <= 0:  # the last one with words stays open
            out[j] = x
        else:
            up, down = min(a * (1 - x), rest * x), min(a * x, rest * (1 - x))
            move = up if chance[j] * (up + down) < down else -down
            out[j], x = x + move / a, x - move / rest
            out[j] = out[j] if NEAR < out[j] < 1 - NEAR else round(out[j])
    rows["fraction"] = out
    return rows


def _uniform(*parts: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(2**53))).cast("double")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Return doc_id, size, source_size, target, taken and copies for each row of docs; see `dealt`."""
    return dealt(docs, **options).select("doc_id", "size", "source_size", "target", "taken", "copies")


def dealt(docs: DataFrame, most: float = 3.0, cycle: tuple[int, ...] = (1, 2, 3), seed: int = 11, key: str = "doc_id") -> DataFrame:
    """Return key, source, size, source_size, target, copies and taken for each row of docs (key, text, source).

    Size is the number of words. copies is a whole number, at most `most`; taken = copies * size. A null text
    has size 0; a null source is a source of its own; rows that repeat, keys included, are rounded each for
    itself; null keys are allowed. Texts of any length are counted whole. Documents of equal size (ties) are
    taken in a random order that the seed fixes. A source without words has target 0 and takes nothing. The same
    rows and seed give the same result, however the rows are dealt out; rows alike in key, text and source may
    swap their copies. An empty table gives an empty result. Other columns are ignored. `text_id`, a hash of the
    text, tells apart rows that share a key.
    """
    kind = docs.schema[key].dataType  # keys go through pandas as text, where whole numbers with nulls would turn into floats
    alike = docs.select(F.col(key).cast("string").alias("key"), word_count(F.col("text")).alias("size"), F.col("source").alias("source"), text_id(F.col("text")).alias("text_id"))
    # rows alike are counted and numbered, so that they too fall into chunks of bounded size
    alike = saved(alike.groupBy("key", "source", "size", "text_id").agg(F.count("*").alias("times")))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / CHUNK))).alias("block")
    sized = alike.select("*", blocks).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(CHUNK), F.col("times") - F.col("block") * CHUNK))).alias("nth"))
    sources = cyclic_weights(alike.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum("times").alias("docs")), cycle)
    sources = saved(targets(saved(sources), most))
    goal = broadcast_if_small(sources.select(F.col("source").alias("of"), "source_size", "docs", "target"), SIDE_ROWS)
    copies = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    chunks = F.ceil(F.col("docs") / CHUNK)
    level = (
        sized.join(goal, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("each", copies)
        .withColumn("base", F.floor(F.col("each") + F.lit(NEAR)))
        .select(
            "key", "size", "source", "text_id", "source_size", "target", "base",
            F.greatest(F.col("each") - F.col("base"), F.lit(0.0)).alias("fraction"),
            _uniform(F.col("key"), F.col("text_id"), F.col("block"), F.col("nth"), F.lit(seed)).alias("chance"),
            F.pmod(F.xxhash64("key", "text_id", "block", F.lit(seed + 1)), chunks).alias("chunk"),
        )
    )
    most_chunks = max(1, -(-(sources.agg(F.max("docs")).first()[0] or 0) // CHUNK))
    done, round_ = None, _pool
    while True:
        level, round_ = saved(level.groupBy("source", "chunk").applyInPandas(round_, level.schema)), _pivot
        last = most_chunks == 1
        open_ = (F.col("fraction") > 0) & (F.col("fraction") < 1)
        rounded = level if last else level.filter(~open_)
        done = rounded if done is None else done.unionByName(rounded)
        if last:
            break
        most_chunks = -(-most_chunks // FAN_IN)
        level = level.filter(open_).withColumn("chunk", F.floor(F.col("chunk") / FAN_IN)).withColumn("chance", _uniform(F.col("chance"), F.lit(most_chunks)))
    extra = (F.col("fraction") > _uniform(F.col("chance"), F.lit(seed))).cast("long")  # 0 and 1 stay what they are
    whole = F.least(F.col("base") + extra, F.lit(int(most))).cast("long")
    return done.select(F.col("key").cast(kind).alias(key), "source", "text_id", "size", "source_size", "target", whole.alias("copies"), (whole * F.col("size")).alias("taken"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that a mixture takes at least once, with size, source_size, target, copies and taken.

    Rows alike in doc_id, source and text take the copies dealt to them in any order. Columns of docs named like
    a result are replaced; all others stay, whatever their names.
    """
    results = ["size", "source_size", "target", "copies", "taken"]
    lots = dealt(docs, **options).select(F.struct("doc_id", "source", "text_id").alias("k"), "source_size", "target", "copies").groupBy("k")
    lots = lots.agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.min("copies").alias("least"), F.sum("copies").alias("all"), F.count("*").alias("rows"))
    rest = [c for c in docs.columns if c.lower() not in results]
    row = F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row")
    rows = docs.select(row, word_count(F.col("text")).alias("size"), F.struct("doc_id", "source", text_id(F.col("text")).alias("text_id")).alias("k"))
    # copies of rows alike differ by one at most: so many of them take one more; they are numbered only where that is not all or none
    rows = rows.join(lots, rows["k"].eqNullSafe(lots["k"])).drop(lots["k"]).withColumn("more", F.col("all") - F.col("least") * F.col("rows"))
    alone = rows.filter("more = 0").withColumn("copies", F.col("least"))
    salt = F.spark_partition_id()
    mixed = saved(rows.filter("more > 0").withColumn("salt", salt))
    ahead = mixed.groupBy("k", "salt").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(W.partitionBy("k").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ahead = ahead.select(F.col("k").alias("k2"), F.col("salt").alias("salt2"), "ahead")
    nth = F.row_number().over(W.partitionBy("k", "salt").orderBy("size"))
    mixed = mixed.join(ahead, mixed["k"].eqNullSafe(ahead["k2"]) & (mixed["salt"] == ahead["salt2"])).withColumn("nth", nth + F.col("ahead"))
    mixed = mixed.withColumn("copies", F.col("least") + (F.col("nth") <= F.col("more")).cast("long"))
    out = alone.unionByName(mixed.select(*alone.columns)).filter("copies > 0")
    return out.select(*(F.col("row").getField(c).alias(c) for c in rest), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
