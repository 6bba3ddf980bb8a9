"""Near-copies by the Jaccard similarity of word shingles: candidates from SimHash and MinHash bands, then the exact share.

Fingerprints within a few bits of each other are linked by the BK-trees of `simhash`, and the texts of a group are
compared with one of it. Those 64 bits are too few for all pairs of similarity 0.8: about ten bits differ, and blocks
of bits small enough for that select almost nothing. So candidates come from MinHash bands besides. A band is a hash of several least hashes of the shingles. Texts that
share a band are compared with the one of their band that meets most others. Where a band still holds several
groups, those of its members that may be alike by their least hashes (AGREE) are gathered in clusters, and in a
cluster the sets of members of different groups are compared exactly. Only links that join two groups are
written: there are fewer of them than texts, however many pairs are alike. Texts and sets are told apart by 128
bits; different sets are numbered, and the numbers are the nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import saved, text_key, text_of
from quillstone.llm.graphs import components
from quillstone.llm.simhash import RADIUS, fingerprint, groups, shingle_hashes

WIDTH, SHARE = 5, 0.8
#: Two documents of similarity s share a band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.99995 at 0.8.
BANDS, ROWS = 25, 5
STEP = 1 << 12
#: Members of a band that are in different groups are compared if so many least hashes agree; of pairs at 0.8 (100 on average, deviation 4.5) about two in a million do not.
AGREE = 78
#: A band or a cluster with more members, and a cluster with more shingles, is searched in pairs of parts of this size, each pair as a group of its own.
PART, PART_SHINGLES = 1024, 1 << 22
_RANDOM = np.random.default_rng(20).integers(0, 1 << 64, (3, BANDS * ROWS), np.uint64)
_FLIP, _ODD, _WEIGHT = _RANDOM[0][:, None], _RANDOM[1][:, None] | np.uint64(1), _RANDOM[2].reshape(BANDS, ROWS) | np.uint64(1)


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), STEP):
        least = np.minimum(least, ((hashes[None, i : i + STEP] ^ _FLIP) * _ODD).min(axis=1))
    return (least >> np.uint64(32)) ^ least


def bands(least: np.ndarray) -> np.ndarray:
    mixed = least.reshape(BANDS, ROWS) * _WEIGHT
    key = np.bitwise_xor.reduce(mixed ^ (mixed >> np.uint64(29)), axis=1) * np.uint64(0x9E3779B97F4A7C15)
    return (key ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _arrays(batch: pa.Array, make) -> pa.Array:
    found = [make(x.as_py() or "") for x in batch]
    ends = np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))


def _signatures(width: int):
    def signature(text: str) -> np.ndarray:
        """128 bits of the whole set and the SimHash; if the set is not empty, its bands and the low bytes of its least hashes."""
        found = shingle_hashes(text, width)
        whole = np.r_[np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64), np.array([fingerprint(text)], np.uint64).view(np.int64)]
        if not len(found):
            return whole
        least = least_hashes(found)
        return np.r_[whole, bands(least), np.r_[least.astype(np.uint8), np.zeros(-len(least) % 8, np.uint8)].view(np.int64)]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _arrays(batch, signature)

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _arrays(batch, lambda text: shingle_hashes(text, width).view(np.int64))

    return run


def _text_id(docs: DataFrame):
    return text_key(text_of(docs["text"]))


def _shingle_sets(asked: DataFrame, docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, set of the asked nodes."""
    asked = asked.join(nodes.select("node", "text_id"), "node")
    texts = docs.select(_text_id(docs).alias("text_id"), text_of("text").alias("text"))
    texts = texts.join(asked.select("text_id").distinct(), "text_id", "left_semi").dropDuplicates(["text_id"])
    sets = texts.select("text_id", F.arrow_udf(_sets(width), "array<long>")("text").alias("set"))
    return saved(asked.join(sets, "text_id").select("node", "set"))


def _similar(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, share: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingles are as alike as asked for."""
    sets = _shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs, nodes, width)
    x, y = sets.select(F.col("node").alias("b"), F.col("set").alias("y")), sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    both = pairs.join(x, "b").join(y, "a").select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("hit"))
    return saved(both.filter(F.col("hit") >= (F.col("n") - F.col("hit")) * F.lit(share) - F.lit(1e-9)).select("a", "b"))


class Groups:
    """Union-find over the places of an array."""

    def __init__(self, names: np.ndarray):
        _, first, at = np.unique(names, return_index=True, return_inverse=True)
        self.parent = first[at].tolist()

    def top(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.top(i), self.top(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def _least(d: pd.DataFrame) -> np.ndarray:
    return np.stack(d["least_hashes"].to_numpy()).astype(np.int64).view(np.uint8)[:, : BANDS * ROWS]


def _may_be_alike(d: pd.DataFrame) -> pd.DataFrame:
    """Of the members of a band, pairs that join all those of different groups that may be alike."""
    d = d.sort_values("node")
    node, root, least = d["node"].to_numpy(), d["root"].to_numpy(), _least(d)
    groups, pairs = Groups(node), []
    for i in range(len(node)):
        near = np.flatnonzero((least[i + 1 :] == least[i]).sum(axis=1) >= AGREE) + i + 1
        pairs += [(node[i], node[j]) for j in near[root[near] != root[i]].tolist() if groups.join(i, j)]
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    return pd.DataFrame({"a": a, "b": b})


def _alike(share: float):
    def run(d: pd.DataFrame) -> pd.DataFrame:
        """Of the members of a cluster, pairs that are alike and join all groups that have such a pair."""
        d = d.sort_values(["root", "node"])
        node, least, sets = d["node"].to_numpy(), _least(d), d["set"].to_list()
        sizes, groups, pairs = np.array([len(x) for x in sets]), Groups(d["root"].to_numpy()), []
        top = np.array([groups.top(i) for i in range(len(node))])
        for i in range(len(node)):
            near = np.flatnonzero((top[i + 1 :] != top[i]) & ((least[i + 1 :] == least[i]).sum(axis=1) >= AGREE)) + i + 1
            near = near[np.minimum(sizes[near], sizes[i]) >= share * np.maximum(sizes[near], sizes[i]) - 1e-9]
            for some in np.split(near, range(256, len(near), 256)):
                some = some[top[some] != top[i]]
                if not len(some):
                    continue
                own, others = sets[i], np.concatenate([sets[j] for j in some])
                found = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
                hit = np.add.reduceat(found, np.r_[0, np.cumsum(sizes[some])[:-1]])
                for j in some[hit >= share * (sizes[some] + sizes[i] - hit) - 1e-9].tolist():
                    if groups.join(i, j):
                        pairs.append((node[i], node[j]))
                        top = np.where(top == max(top[i], top[j]), min(top[i], top[j]), top)
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        return pd.DataFrame({"a": a, "b": b})

    return run


def _in_parts(rows: DataFrame, key: str, parts: DataFrame) -> DataFrame:
    """The rows, each in the shards of its key: a key of several parts has a shard for every pair of parts."""
    part, other = F.pmod(F.xxhash64("node"), F.col("parts")), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    return rows.join(parts, key).withColumn("shard", F.explode(F.transform(other, lambda j: F.xxhash64(key, F.least(part, j), F.greatest(part, j)))))


def _simhash_pairs(each: DataFrame, nodes: DataFrame, radius: int) -> DataFrame:
    """Candidates (a, b): the nodes whose SimHashes link within the radius, each with the least node of its group."""
    linked = groups(saved(each.select("print").distinct()), radius)
    prints = each.select("k1", "k2", "print").distinct().join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).select("node", "print")
    members = saved(prints.join(linked.select(F.col("node").alias("print"), "root"), "print", "left").select("node", F.coalesce("root", "print").alias("root")))
    # saved: the join is then no part of the grouping, and Spark can split a large group
    heads = saved(members.groupBy("root").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a < last").select("root", "a"))
    return members.join(heads, "root").filter("node != a").select("a", F.col("node").alias("b"))


def _links(docs: DataFrame, nodes: DataFrame, keyed: DataFrame, near: DataFrame, width: int, share: float) -> DataFrame:
    """node, root of all nodes that are alike, of those that share a band (keyed) and of the pairs of near."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = saved(keyed.join(sizes, "key"))
    # the member that meets the most others stands for its band: of a large group that is the text the others are copies of
    degree = members.groupBy("node").agg(F.sum("n").alias("met"))
    heads = members.join(degree, "node").groupBy("key").agg(F.max(F.struct("met", "node")).alias("a")).select("key", "a.node").withColumnRenamed("node", "a")
    members = saved(members.select("key", "node").join(heads, "key"))
    star = saved(members.filter("node != a").select(F.least("node", "a").alias("a"), F.greatest("node", "a").alias("b")).unionByName(near).distinct())
    links = _similar(star, docs, nodes, width, share)
    roots = saved(components(links))
    rooted = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r < s").select("key")
    rooted = saved(rooted.join(mixed, "key"))
    parts = rooted.groupBy("key").agg(F.ceil(F.count("*") / PART).alias("parts"))
    # the hashes are joined before the parts are laid out, each node's once for each of its bands
    dealt = _in_parts(rooted.join(nodes.select("node", "least_hashes"), "node"), "key", parts).select("shard", "node", "root", "least_hashes")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # asked for: by bytes alone Spark would put this work into few tasks
    clusters = saved(components(dealt.repartition(tasks, "shard").groupBy("shard").applyInPandas(_may_be_alike, "a long, b long"))).withColumnRenamed("root", "cluster")
    if clusters.isEmpty():
        return roots
    sets = _shingle_sets(clusters.select("node"), docs, nodes, width)
    each = clusters.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(sets, "node").join(nodes.select("node", "least_hashes"), "node")
    each = saved(each)
    parts = each.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum(F.size("set")) / PART_SHINGLES)).alias("parts"))
    dealt = _in_parts(each, "cluster", parts).select("shard", "node", "root", "least_hashes", "set")
    rest = dealt.repartition(tasks, "shard").groupBy("shard").applyInPandas(_alike(share), "a long, b long")
    return components(links.unionByName(rest))


def one_of_each(docs: DataFrame, width: int = WIDTH, share: float = SHARE, radius: int = RADIUS) -> DataFrame:
    """The documents without those that are near-copies of one with a smaller doc_id; the rest unchanged.

    Two texts are near-copies if the Jaccard similarity of their shingles of `width` words is at least
    `share`, A to Z lower-cased; so is what a chain of near-copies joins. Candidates are texts whose SimHashes
    link within `radius` bits, and texts that share a MinHash band. A pair just at 0.8 is compared with
    probability 0.99995 (BANDS, AGREE), a more similar one with a higher; what is compared is decided exactly. A text of fewer words is one
    shingle; null and empty texts are near-copies of each other. Rows are judged each by its own text. Of
    rows that share the kept doc_id, and of a group without doc_ids, all stay. An empty table gives an empty
    result. Texts of any length are read whole. Columns of any names are kept.
    """
    signature = F.arrow_udf(_signatures(width), "array<long>")
    each = docs.select("doc_id", _text_id(docs).alias("text_id"), signature(text_of("text")).alias("s"))
    parts = {"k1": F.get("s", F.lit(0)), "k2": F.get("s", F.lit(1)), "print": F.get("s", F.lit(2)), "keys": F.slice("s", 4, BANDS), "least_hashes": F.slice("s", 4 + BANDS, 1 << 20)}
    each = saved(each.select("doc_id", "text_id", *(c.alias(name) for name, c in parts.items())))
    nodes = each.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.min("text_id").alias("text_id"), F.first("keys").alias("keys"), F.first("least_hashes").alias("least_hashes"))
    # numbered in order, so that a rerun gives the same numbers; the written table fixes them
    nodes = saved(nodes.sortWithinPartitions("k1", "k2").withColumn("node", F.monotonically_increasing_id()))
    near = _simhash_pairs(each, nodes, radius)
    roots = _links(docs, nodes, nodes.select("node", F.explode("keys").alias("key")), near, width, share)
    rooted = nodes.join(roots, "node", "left").select("k1", "k2", "least", F.coalesce("root", "node").alias("root"))
    kept = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("kept")), "root").select("k1", "k2", "kept").filter(F.col("kept").isNotNull())
    dropped = each.join(kept, ["k1", "k2"]).filter(~F.col("doc_id").eqNullSafe(F.col("kept"))).select(F.struct("doc_id", "text_id").alias("gone")).distinct()
    return docs.join(dropped, F.struct(docs["doc_id"], _text_id(docs).alias("text_id")).eqNullSafe(dropped["gone"]), "left_anti")
