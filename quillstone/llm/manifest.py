"""Merkle dataset manifest by sibling-shift self-joins.

Each row is a leaf, and the leaves of a tree are numbered. On every level the node in slot zero of each run of
ARITY nodes asks for its siblings by their computed numbers (its own plus 0 to ARITY - 1), an equijoin of the
level with itself brings their digests, and the slot-zero rows emit the parents. Proofs go the other way: the
runs of a level join the path of their parent, and the leaves join the path of their run. Digests are lowercase
hex of SHA-256, and parents hash the hex text of their children in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.llm.common import ascii_lower, broadcast_if_small, saved

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Where each tree begins in each range of rows: this many rows are broadcast at most.
SIDE_ROWS = 100_000
PATH = "array<struct<slot:int,kids:array<string>>>"


def framed(value: Column) -> Column:
    """UTF-8 byte count, a colon and the value; a hyphen for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(docs: DataFrame, **instead: Column) -> Column:
    """The digest of a row's FIELDS, some of them replaced."""
    return F.sha2(F.concat(*(framed(instead.get(c, F.col(c))) for c in FIELDS)), 256)


def combined(kids: Column) -> Column:
    return F.sha2(F.array_join(kids, ""), 256)


def numbered(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """Add at, a row's place from 0 in its tree, and total, the rows of the tree.

    The rows are saved in ranges of (tree, order), so that a tree of any size is cut into many; a row's place is
    that in its range and the rows of its tree in the ranges before.
    """
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(F.col(tree), *order, "_row")
    dealt = saved(dealt.sortWithinPartitions(tree, *order, "_row").drop("_row").withColumn("_id", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()))
    parts = dealt.groupBy(tree, "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(tree).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(tree, "_range", "_first", before.alias("_before"), F.sum("_n").over(W.partitionBy(tree)).alias("total"))
    out = dealt.join(broadcast_if_small(parts, SIDE_ROWS), [tree, "_range"])
    return out.withColumn("at", F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_range", "_first", "_before")


def levels(nodes: DataFrame, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """From (tree, at, total, digest) build all trees at once.

    Returns the runs of each level, lowest first, (tree, at, last, kids) with the number of the parent and whether
    it is the last node of its tree, and these last nodes (tree, digest). A tree of one node has no run. Each
    level is saved, 1 / arity of the one below; there are as many as the largest tree is high.
    """
    runs, tops, level = [], nodes.filter("total = 1").select("tree", "digest"), nodes
    size = nodes.agg(F.max("total")).first()[0] or 0
    while size > 1:
        level = level.filter("total > 1")
        slots = F.sequence(F.lit(0), F.least(F.lit(arity), F.col("total") - F.col("at")).cast("int") - 1)
        asked = level.filter(F.col("at") % arity == 0).select("tree", F.col("at").alias("head"), "total", F.explode(slots).alias("slot"))
        siblings = asked.withColumn("at", F.col("head") + F.col("slot")).join(level.select("tree", "at", "digest"), ["tree", "at"])
        kids = F.transform(F.array_sort(F.collect_list(F.struct("slot", "digest"))), lambda x: x["digest"])
        emitted = siblings.groupBy("tree", "head", "total").agg(kids.alias("kids"))
        emitted = saved(emitted.select("tree", F.expr(f"head div {arity}").alias("at"), F.ceil(F.col("total") / arity).alias("total"), "kids"))
        runs.append(emitted.select("tree", "at", (F.col("total") == 1).alias("last"), "kids"))
        level = emitted.select("tree", "at", "total", combined(F.col("kids")).alias("digest"))
        tops = tops.unionByName(level.filter("total = 1").select("tree", "digest"))
        size = -(-size // arity)
    return runs, tops


def _step(at: Column, kids: Column, arity: int) -> Column:
    """The part of a path that goes through one run, for the node of a number."""
    return F.array(F.struct((at % arity).cast("int").alias("slot"), kids.alias("kids")))


def with_paths(nodes: DataFrame, runs: list[DataFrame], tops: DataFrame, arity: int = ARITY) -> DataFrame:
    """Add path to nodes (tree, at, total, ...) and the columns of tops (tree, tail, ...) but tail.

    A path lists slot and kids of the runs from the node's own to the last of its tree, and then the tail. Trees
    of any size are joined by the numbers of their runs; by tree alone only one row of each tree is.
    """
    rest = [c for c in tops.columns if c not in ("tree", "tail")]
    above = None
    for run in reversed(runs):
        found = run.filter("last").join(tops, "tree").select("tree", "at", "kids", F.col("tail").alias("beyond"), *rest)
        if above is not None:
            upper = above.select("tree", F.col("at").alias("up"), F.col("kids").alias("upper"), "beyond", *rest)
            lower = run.filter("NOT last").withColumn("up", F.expr(f"at div {arity}")).join(upper, ["tree", "up"])
            found = found.unionByName(lower.select("tree", "at", "kids", F.concat(_step(F.col("at"), F.col("upper"), arity), "beyond").alias("beyond"), *rest))
        above = found
    columns = nodes.columns
    alone = nodes.filter("total = 1").join(tops, "tree").select(*columns, F.col("tail").alias("path"), *rest)
    if above is None:
        return alone
    own = above.select("tree", F.col("at").alias("run"), "kids", "beyond", *rest)
    held = nodes.filter("total > 1").withColumn("run", F.expr(f"at div {arity}")).join(own, ["tree", "run"])
    return alone.unionByName(held.select(*columns, F.concat(_step(F.col("at"), F.col("kids"), arity), "beyond").alias("path"), *rest))


def siblings_digest(path: Column) -> Column:
    """The digest of all siblings on a path, in its order and left to right."""
    own = F.transform(path, lambda step: F.array_join(F.filter(step["kids"], lambda kid, i: i != step["slot"]), ""))
    return F.sha2(F.array_join(own, ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda node, step: combined(F.transform(step["kids"], lambda kid, i: F.when(i == step["slot"], node).otherwise(kid))))


def build(docs: DataFrame, leaf: Column | None = None, *more: Column, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, path and `more` (computed from docs) of each row.

    Trees are by lang, null for itself and first; their leaves ascend by doc_id, null first. Rows that share a
    doc_id are in order of their digests; whole repeats are leaves of their own, alike but for their paths. A
    lone leaf is its tree's subroot, a lone subroot the root. Null fields have a digest of their own, other than
    empty ones. Texts of any length are hashed at the scan and not carried further. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree")
    rows = docs.select("doc_id", tree, (leaf_digest(docs) if leaf is None else leaf).alias("digest"), *more)
    leaves = numbered(rows, "tree", [F.col("doc_id"), F.col("digest")])
    runs, tops = levels(leaves.select("tree", "at", "total", "digest"), arity)
    # the trees' last nodes are the leaves of one more tree
    trees = numbered(tops.select(F.lit("").alias("all"), "tree", "digest"), "all", [F.col("tree")])
    forest = trees.select(F.col("all").alias("tree"), "at", "total", "digest", F.col("tree").alias("of"))
    over, root = levels(forest.select("tree", "at", "total", "digest"), arity)
    root = root.select("tree", F.expr(f"CAST(array() AS {PATH})").alias("tail"), F.col("digest").alias("root"))
    ends = with_paths(forest, over, root, arity).select(F.col("of").alias("tree"), F.col("path").alias("tail"), F.col("digest").alias("subroot"), "root")
    out = with_paths(leaves, runs, saved(ends), arity)
    return out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", *(c for c in rows.columns if c not in ("doc_id", "tree", "digest")))


def checked(docs: DataFrame, every: int = 3) -> DataFrame:
    """Build the manifest and check it against a copy whose texts are lower-cased (A to Z) in every `every`-th row.

    Rows are chosen by crc32 of their doc_id in decimal; rows without one are not. folded_root is what the copy's
    leaf gives with the original siblings, and verified whether that is the root.
    """
    lowered = leaf_digest(docs, text=ascii_lower(F.col("text")))
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % every == 0, F.lit(False))
    out = build(docs, None, F.when(chosen, lowered).alias("tampered"))
    out = out.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
