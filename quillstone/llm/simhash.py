"""SimHash near-duplicates, linked by BK-trees over shards of the fingerprints.

Two fingerprints that differ in few bits agree on all but a few of their blocks of bits. A shard holds the
fingerprints that agree on the rest, so all links lie inside shards. In each shard a BK-tree, whose children
are keyed by their Hamming distance to the parent, is searched along the edges within the radius. The trees
reach their tasks by a shuffle: as they hold every fingerprint, a broadcast of them would have no bound. In a
shard of two the tree is one edge, and so one distance; such shards are decided in arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import saved
from quillstone.llm.graphs import components

BITS, WIDTH, RADIUS, SEED = 64, 4, 4, 42
#: Blocks of bits; a shard agrees on all but RADIUS of them.
BLOCKS = 6
#: A shard with more fingerprints is searched in pairs of parts of this size, each pair in a task of its own.
SHARD = 1024
STEP = 1 << 14


def _hashed(text: str, width: int) -> np.ndarray:
    """A hash for each word shingle, A to Z lower-cased; a text of fewer words is one shingle."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: exactly the ASCII letters and white space
    if not parts:
        return np.empty(0, np.uint64)
    body, width = b" ".join(parts), min(width, len(parts))
    ends = list(accumulate(len(p) + 1 for p in parts))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(body[s : e - 1], SEED) for s, e in zip([0, *ends], ends[width - 1 :])), np.uint64, len(parts) - width + 1)


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of the text's word shingles, ascending."""
    return np.unique(_hashed(text, width))


def fingerprint(text: str, width: int = WIDTH) -> int:
    """The SimHash of the text's word shingles, A to Z lower-cased; 0 if there are no words."""
    hashes = _hashed(text, width)
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), STEP):
        part = hashes[i : i + STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array(np.array([fingerprint(x.as_py() or "") for x in batch], np.uint64).view(np.int64))


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.root: list | None = None

    def near(self, value: int, radius: int) -> list[int]:
        """Places of the entries within the radius."""
        found, open_ = [], [self.root] if self.root else []
        while open_:
            own, place, children = open_.pop()
            d = (own ^ value).bit_count()
            if d <= radius:
                found.append(place)
            for at in range(max(0, d - radius), d + radius + 1):
                if at in children:
                    open_.append(children[at])
        return found

    def add(self, value: int, place: int) -> None:
        if self.root is None:
            self.root = [value, place, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d not in node[2]:
                node[2][d] = [value, place, {}]
                return
            node = node[2][d]


def _linked(values: list[int], radius: int, ask: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links (place, least place of its group) that join all values within the radius of each other."""
    parent, tree = list(range(len(values))), BKTree()

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        for j in tree.near(value, radius):
            a, b = top(i), top(j)
            parent[max(a, b)] = min(a, b)
        tree.add(value, i)
    return [(i, top(i)) for i in range(len(values)) if top(i) != i]


def _links(radius: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by shard; a shard may be spread over batches, and is at most two parts large."""

        def link(keys: np.ndarray, prints: np.ndarray) -> pd.DataFrame:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            two = starts[sizes == 2]
            x, y = prints[two], prints[two + 1]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= radius
            a, b = [x[near]], [y[near]]
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                part = prints[s : s + n]
                found = np.array(_linked([int(v) for v in part.view(np.uint64)], radius), np.int64).reshape(-1, 2)
                a.append(part[found[:, 0]])
                b.append(part[found[:, 1]])
            return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

        keys, prints = np.empty((0, 1), np.int64), np.empty(0, np.int64)
        for frame in frames:
            keys, prints = np.r_[keys.ravel(), frame["shard"].to_numpy()], np.r_[prints, frame["print"].to_numpy()]
            if len(keys) and keys[0] != keys[-1]:
                cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
                yield link(keys[:cut], prints[:cut])
                keys, prints = keys[cut:], prints[cut:]
        if len(keys):
            yield link(keys.ravel(), prints)

    return run


def _shards(blocks: int, radius: int) -> Column:
    """For every choice of blocks that must agree: a number for the choice and the agreeing bits."""
    width = -(-BITS // blocks)
    spans = [(i * width, min(BITS, (i + 1) * width)) for i in range(blocks)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << b) - (1 << a)) for a, b in (spans[i] for i in chosen))
        keys.append(F.xxhash64(F.lit(n), F.col("print").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*keys)


def groups(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard: int = SHARD) -> DataFrame:
    """node, root for every fingerprint (column print, distinct) that links to another within the radius.

    Shard keys are hashes; two shards that share one are searched as one, which adds work but no link. A shard over the size is cut
    into parts, and every pair of parts is searched, so no link is lost.
    """
    keyed = prints.select(F.explode(_shards(blocks, radius)).alias("key"), "print")
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > shard).select("key", F.ceil(F.col("n") / shard).alias("parts"))
    large = saved(large)
    part = F.pmod(F.xxhash64("print"), F.col("parts"))
    other = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    pairs = F.transform(other, lambda j: F.xxhash64("key", F.least(part, j), F.greatest(part, j)))
    if large.isEmpty():
        dealt = keyed.select(F.col("key").alias("shard"), "print")
    else:
        joined = keyed.join(large, "key", "left")
        dealt = joined.select(F.explode(F.when(F.col("parts").isNull(), F.array("key")).otherwise(pairs)).alias("shard"), "print")
    ordered = dealt.repartition("shard").sortWithinPartitions("shard", "print")
    return components(ordered.mapInPandas(_links(radius), "a long, b long"))


def classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id reachable, for each row.

    Null and empty texts have fingerprint 0 and link like any other. Equal fingerprints are one node, so a group of copies costs one.
    Null doc_ids are kept; they are never a component_id unless a component has no other. Repeated rows
    stay. Texts of any length are read whole. A bit that exactly half of the hashes set (a tie) is not set. An
    empty table gives an empty result; other columns are ignored.
    """
    each = saved(docs.select("doc_id", F.arrow_udf(_fingerprints, "long")(F.coalesce("text", F.lit(""))).alias("print")))
    prints = saved(each.groupBy("print").agg(F.min("doc_id").alias("least")))
    roots = groups(prints.select("print"), radius)
    rooted = prints.join(roots, prints["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    # saved: the join is then no part of the grouping, and Spark can split a large component
    least = saved(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    ids = rooted.join(least, "root").select("print", "component_id")
    return each.join(ids, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents without those that are near-copies of one with a smaller doc_id; the rest unchanged.

    Of rows that share the kept doc_id, and of a component without doc_ids, all stay; columns may have any names.
    """
    found = classes(docs, radius)
    dropped = found.filter(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.struct("doc_id").alias("gone")).distinct()
    return docs.join(dropped, F.struct(docs["doc_id"]).eqNullSafe(dropped["gone"]), "left_anti")
