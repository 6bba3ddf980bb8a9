"""Line dedup by a deletion-neighbourhood join.

Equal lines are one line, kept where it comes first. Lines within one edit are found by deletion variants: a
line emits the hash of itself and of each text with one character deleted, and lines that share a variant are
joined and verified. Only lines that share half of their text, at the front or at the back, with another line
can be within one edit, so only these emit variants; this leaves no pair out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import broadcast_if_small, columns_of, held, released, saved, text_key, text_of
from quillstone.llm.hashing import ODD, mix

#: Shorter lines are always kept: they repeat by chance.
LEAST = 20
#: So many ids of candidate lines (24 bytes each) are broadcast at most.
SIDE_ROWS = 1_000_000
_BASE = np.uint64(ODD | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def neighbourhood(line: str) -> np.ndarray:
    """Hashes of the line and of every text with one character deleted, in order of its place.

    Prefix sums of a polynomial over the characters give each variant in constant time.
    """
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(0, len(codes) - 1), _BASE)])
    sums = np.r_[np.uint64(0), np.add.accumulate(mix(codes + np.uint64(1)) * powers[: len(codes)])]
    whole = sums[-1]
    deleted = sums[:-1] + (whole - sums[1:]) * _BACK
    lengths = np.r_[np.uint64(len(codes)), np.full(len(codes), max(0, len(codes) - 1), np.uint64)]
    return mix(np.r_[whole, deleted] ^ mix(lengths)).view(np.int64)


def _neighbourhoods(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        found = [neighbourhood(x.as_py()) for x in batch]
        ends = np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32)
        yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))


def _rebuilt(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """text, places of the lines that it keeps, least length. Of equal lines in a text the first stays."""
    for texts, kept, least in batches:
        out = []
        bound = least[0].as_py() if len(least) else 0
        for text, keep in zip(texts, kept, strict=True):
            lines, open_, seen, left = text.as_py().split("\n"), set(keep.as_py() or ()), set(), []
            for at, line in enumerate(lines):
                if len(line) < bound or at in open_ and line not in seen:
                    left.append(line)
                    seen.add(line)
            out.append({"text": "\n".join(left), "n_lines": len(lines), "n_removed": len(lines) - len(left)})
        yield pa.array(out, pa.struct([("text", pa.string()), ("n_lines", pa.int32()), ("n_removed", pa.int32())]))


def _halves(line: Column) -> Column:
    """Keys of the front and the back half; lines of n and n + 1 characters share the half of n."""
    n = F.length(line)
    keys = []
    for half in (F.floor(n / 2), F.floor((n - 1) / 2)):
        half = half.cast("int")
        keys += [F.xxhash64(F.lit(0), half, F.substring(line, F.lit(1), half)), F.xxhash64(F.lit(1), half, F.substring(line, n - half + 1, half))]
    return F.array_distinct(F.array(*keys))


def _near(docs: DataFrame, firsts: DataFrame, least: int) -> DataFrame:
    """The ids of lines that have an earlier line within one edit."""
    keyed = firsts.select("id", F.explode(F.filter(F.array("k0", "k1", "k2", "k3"), lambda k: k.isNotNull())).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    asked = keyed.join(shared, "key", "left_semi").select("id").distinct()
    asked = saved(asked.join(firsts.select("id", "doc"), "id").select("id", F.col("doc").alias("_of")))
    texts = docs.select("doc_id", F.posexplode_outer(F.split(text_of("text"), "\n")).alias("at", "line")).filter(F.length("line") >= least)
    texts = texts.withColumn("id", text_key(F.col("line")))
    # the lines asked for are few next to all; within the bound they go to the texts, and else both are shuffled
    few = broadcast_if_small(asked, SIDE_ROWS)
    texts = texts.join(few, (texts["id"] == few["id"]) & texts["doc_id"].eqNullSafe(few["_of"]), "left_semi")
    first = texts.groupBy("id").agg(F.min(F.struct("doc_id", "at", "line")).alias("x"))
    lines = saved(first.select("id", F.struct(F.col("x.doc_id").isNull().alias("none"), "x.doc_id", "x.at", "id").alias("order"), "x.line"))
    variants = lines.select("id", F.posexplode_outer(F.arrow_udf(_neighbourhoods, "array<long>")("line")).alias("at", "variant"))
    deleted = variants.filter("at > 0").select("id", "variant", F.xxhash64("variant", "at").alias("bucket"))
    # one character exchanged: both delete the same place. Only buckets of several lines go on, and there each line
    # is joined to the earliest, not to each other.
    several = deleted.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("bucket")
    several = broadcast_if_small(saved(several), SIDE_ROWS)
    members = saved(deleted.join(several, "bucket").select("bucket", "id").join(lines.select("id", "order"), "id"))
    best = members.groupBy("bucket").agg(F.min("order").alias("best"))
    exchanged = members.join(best, "bucket").filter("best < order").select(F.col("id").alias("late"), F.col("best.id").alias("early"))
    # one character more: a variant equals a whole line
    whole = broadcast_if_small(variants.filter("at = 0").select("variant", F.col("id").alias("w")), SIDE_ROWS)
    meet = saved(deleted.select("variant", F.col("id").alias("d")).join(whole, "variant").select("w", "d").distinct())
    meet = meet.join(lines.select(F.col("id").alias("w"), F.col("order").alias("wo")), "w").join(lines.select(F.col("id").alias("d"), F.col("order").alias("do")), "d")
    early, late = F.when(F.col("wo") < F.col("do"), F.col("w")).otherwise(F.col("d")), F.when(F.col("wo") < F.col("do"), F.col("d")).otherwise(F.col("w"))
    longer = meet.select(late.alias("late"), early.alias("early"))
    pairs = exchanged.unionByName(longer).distinct()
    a, b = lines.select(F.col("id").alias("late"), F.col("line").alias("x")), lines.select(F.col("id").alias("early"), F.col("line").alias("y"))
    near = F.levenshtein(F.col("x"), F.col("y"), 1)
    return pairs.join(a, "late").join(b, "early").filter((near >= 0) & (near <= 1)).select(F.col("late").alias("id")).distinct()


def deduplicate(docs: DataFrame, least: int = LEAST, edits: int = 1) -> DataFrame:
    """Remove every line of at least `least` characters that has an earlier line within `edits` (0 or 1).

    Earlier is by doc_id, null last, then by place in the text. Lines are parted by line feeds, white space
    counts, and lines are judged on the input, removed ones included. The text is replaced by the lines that
    stay, and n_lines and n_removed are added; columns with these names are replaced. A null text stays null
    and counts as one empty line. Rows that share a doc_id count as one document and keep the same lines, repeated
    rows too; so do those without one. Ties cannot be: no two lines have one place. Lines are told apart by 128
    bits. Texts and lines of any length are judged whole. An empty table gives an empty result. Other columns may
    have any names.
    """
    if edits not in (0, 1):
        raise ValueError("edits must be 0 or 1")
    split = docs.select(F.col("doc_id").alias("doc"), F.explode_outer(F.split(text_of("text"), "\n")).alias("line")).filter(F.length("line") >= least)
    halves = split.select("doc", text_key(F.col("line")).alias("id"), _halves(F.col("line")).alias("h"))
    keys = [F.get("h", F.lit(i)).alias(f"k{i}") for i in range(4)] if edits else []
    firsts = halves.select("doc", "id", *keys).groupBy("id").agg(F.min("doc").alias("doc"), *(F.min(f"k{i}").alias(f"k{i}") for i in range(4 if edits else 0)))
    firsts = saved(firsts)
    kept = firsts.select("id", "doc")
    if edits:
        kept = kept.join(_near(docs.select("doc_id", "text"), firsts, least), "id", "left_anti")
    # each row gets the verdicts of its own lines only: one doc_id, or null, may hold any share of the rows
    row = F.struct("doc_id", text_key(text_of("text")).alias("text"))
    own = docs.select(row.alias("of"), F.posexplode_outer(F.split(text_of("text"), "\n")).alias("at", "line")).filter(F.length("line") >= least)
    own = own.select("of", "at", text_key(F.col("line")).alias("line"))
    own = own.join(kept, (F.col("line") == F.col("id")) & F.col("of.doc_id").eqNullSafe(F.col("doc")), "left_semi")
    own = own.groupBy("of").agg(F.collect_set("at").alias("kept"))
    rest = columns_of(docs, "n_lines", "n_removed")
    joined = docs.select(held(rest), text_of("text").alias("body"), row.alias("own")).join(own, F.col("own").eqNullSafe(F.col("of")), "left")
    joined = joined.withColumn("new", F.arrow_udf(_rebuilt, "struct<text:string,n_lines:int,n_removed:int>").asNondeterministic()("body", "kept", F.lit(least)))
    text = F.when(F.col("row").getField("text").isNotNull(), F.col("new.text"))
    return joined.select(*released(rest, text=text), "new.n_lines", "new.n_removed")
