"""Exact top-k by inner product, with norm-bucketed candidates.

All candidates are dealt by their length into buckets, the longest first. Every query meets the first bucket;
its k-th best product there is a threshold that goes with it to the others. A bucket that is too short for the
threshold is not sent to the query at all. In a bucket, the threshold over the query's length and the greatest
length of a slice is a local cosine threshold: above 1 it ends the search; if it is high, intervals that it
sets for the query's largest coordinates pick the candidates; if not, a bound on their length does. The
products of what is left are verified exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.llm.common import saved

K = 5
#: Queries of a block, blocks that meet a bucket in one task, numbers of a bucket (8 bytes each), candidates of a slice.
QUERY_BLOCK, TOGETHER, BUCKET_NUMBERS, SLICE = 1024, 16, 1 << 20, 512
#: Local thresholds from which coordinate pruning is used, and the coordinates that it looks at.
STEEP, FOCUS = 0.6, 4
#: Sums of whole numbers are exact in float64 up to here.
EXACT = 2.0**53
MOST = (1 << 63) - 1


def usable(vector: Column, scale: float) -> Column:
    """Whether a vector and its components are neither null nor, scaled, infinite or not a number."""
    x = F.transform(vector, lambda v: v.cast("double") * F.lit(scale))
    return F.coalesce(F.forall(x, lambda v: F.coalesce((F.abs(v) < F.lit(float("inf"))) & ~F.isnan(v), F.lit(False))), F.lit(False))


def _lengths(vectors: np.ndarray) -> np.ndarray:
    """Lengths, a little too great rather than too small; without overflow of the squares."""
    most = np.abs(vectors).max(axis=1, initial=0.0)
    scale = np.where(most > 0, most, 1.0)
    return most * np.sqrt(((vectors / scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-12)


class Bucket:
    """Candidates in descending order of length, in slices."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        norms = _lengths(vectors)
        order = np.lexsort((ids, -norms))
        self.ids, self.vectors, self.norms = ids[order], vectors[order], norms[order]
        with np.errstate(invalid="ignore", divide="ignore"):
            self.units = np.nan_to_num(self.vectors / self.norms[:, None])

    def search(self, own: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, ids and products of each query's k best candidates that reach its floor, ties to the smaller id."""
        if not len(self.ids) or not len(queries):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        lengths = _lengths(queries)
        if not lengths.max() * self.norms[0] < EXACT:
            return self._exact(own, queries, k)
        m = len(queries)
        best = np.full((m, k), -np.inf)
        best_ids = np.full((m, k), np.iinfo(np.int64).max)
        open_ = np.arange(m)
        for start in range(0, len(self.ids), SLICE):
            at = slice(start, start + SLICE)
            ids, top = self.ids[at], self.norms[start]
            floor = np.maximum(best[open_, -1], floors[open_])
            go = floor <= lengths[open_] * top * (1 + 1e-9)  # a local threshold above 1: nothing here or later
            open_, floor = open_[go], floor[go]
            if not len(open_):
                break
            scale = lengths[open_] * top
            with np.errstate(invalid="ignore", divide="ignore"):
                local = np.where(scale > 0, floor / scale, -np.inf)
            steep = (local >= STEEP) & np.isfinite(local)
            flat = open_[~steep]
            if len(flat):  # length pruning: products of the part of the slice that is long enough for any of them
                need = (floor[~steep] / np.maximum(lengths[flat], 1e-300)).min()
                n = int(np.searchsorted(-self.norms[at], -need * (1 - 1e-9), side="right")) if np.isfinite(need) and need > 0 else len(ids)
                self._keep(best, best_ids, own, flat, queries[flat] @ self.vectors[at][:n].T, ids[:n], k)
            for q, t in zip(open_[steep], np.minimum(local[steep], 1.0), strict=True):  # coordinate pruning
                unit = queries[q] / lengths[q]
                fits = np.ones(len(ids), bool)
                for f in np.argsort(-np.abs(unit))[:FOCUS]:
                    half = np.sqrt(max(0.0, (1 - t * t) * (1 - unit[f] * unit[f]))) + 1e-9
                    low, high = unit[f] * t - half, unit[f] * t + half
                    # candidates above the threshold lie in a cone around the query, of which this is the extent
                    low = -1.0 if unit[f] < 0 and -unit[f] >= t else low
                    high = 1.0 if unit[f] > 0 and unit[f] >= t else high
                    fits &= (self.units[at, f] >= low) & (self.units[at, f] <= high)
                pick = np.flatnonzero(fits)
                if len(pick):
                    self._keep(best, best_ids, own, np.array([q]), (self.vectors[at][pick] @ queries[q])[None, :], ids[pick], k)
        rows, cols = np.nonzero(np.isfinite(best))
        return rows, best_ids[rows, cols], best[rows, cols].astype(np.int64)

    @staticmethod
    def _keep(best, best_ids, own, at, products, ids, k) -> None:
        products = np.where(own[at][:, None] == ids[None, :], -np.inf, products)
        both, names = np.concatenate([best[at], products], axis=1), np.concatenate([best_ids[at], np.broadcast_to(ids, products.shape)], axis=1)
        order = np.lexsort((names, -both), axis=1)[:, :k]
        best[at], best_ids[at] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)

    def _exact(self, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As `search`, for products beyond what float64 sums exactly: in Python's whole numbers, candidate by candidate."""
        rows, names, scores = [], [], []
        whole = [list(map(int, v)) for v in self.vectors]
        for i, query in enumerate(queries):
            q = list(map(int, query))
            found = [(-max(-MOST - 1, min(MOST, sum(x * y for x, y in zip(q, v, strict=True)))), int(c)) for v, c in zip(whole, self.ids, strict=True) if c != own[i]]
            for s, c in sorted(found)[:k]:
                rows.append(i)
                names.append(c)
                scores.append(-s)
        return np.array(rows, np.int64), np.array(names, np.int64), np.array(scores, np.int64)


def _matrix(vectors: pd.Series, width: int, scale: float) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(scale * out)


def top_products(vectors: DataFrame, asks: Column, k: int = K, key: str = "vec_id", column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with all rows but its own.

    asks: the condition that makes a row a query; a null counts as false. Components count as floor(scale * x).
    Null, unusable and empty vectors, and null keys, take no part, nor do vectors of which a scaled component is
    beyond float64. Shorter vectors are filled up with zeros. Rows with the query's own key are never its
    candidates. Rows that repeat are separate candidates, and queries with one shared answer. Ties go to the
    smaller key. Products are exact; one beyond a long stands as the nearest long. An empty table gives an empty
    result; other columns are ignored. A vector of any length is taken whole. Every query meets every bucket that
    is long enough for it: work grows as their product, while no task holds more than one bucket and
    TOGETHER blocks of queries.
    """
    v = F.col(column)
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), asks.alias("asked"), v.cast("array<double>").alias("v"), norm.alias("norm"))
    rows = saved(rows.filter(F.col("id").isNotNull() & usable(F.col("v"), scale) & (F.size("v") > 0)))
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("asked"), 1)).alias("q"), F.max(F.size("v")).alias("width")).first()
    width, blocks = counts["width"] or 1, max(1, -(-counts["q"] // QUERY_BLOCK))

    def bucketed(frames):
        found = list(frames)
        if sum(map(len, found)):
            d = pd.concat(found)
            matrix = _matrix(d["v"], width, scale)
            yield pd.DataFrame({"bucket": [TaskContext.get().partitionId()], "top": [float(_lengths(matrix).max())], "c_ids": [d["id"].to_numpy(np.int64).tobytes()], "c": [matrix.tobytes()]})

    spread = F.xxhash64("id", F.monotonically_increasing_id())
    ordered = rows.select("id", "v", "norm", spread.alias("s")).repartitionByRange(max(1, -(-counts["n"] * width // BUCKET_NUMBERS)), F.desc("norm"), "s")
    buckets = saved(ordered.select("id", "v").mapInPandas(bucketed, "bucket long, top double, c_ids binary, c binary"))
    ends = buckets.agg(F.min("bucket"), F.max("bucket")).first()
    first, last = (ends[0] or 0), (ends[1] or 0)
    asked = rows.filter("asked").select("id", "v").dropDuplicates(["id", "v"])

    def packed(d: pd.DataFrame) -> pd.DataFrame:
        matrix, floors = _matrix(d["v"], width, scale), d["floor"].fillna(-np.inf).to_numpy(float)
        lengths = _lengths(matrix)
        with np.errstate(invalid="ignore", divide="ignore"):
            need = np.where((lengths > 0) & (floors > 0), floors / lengths, 0.0).min()
        return pd.DataFrame({"block": [d["block"].iloc[0]], "need": [need * (1 - 1e-9)], "q_ids": [d["id"].to_numpy(np.int64).tobytes()], "q": [matrix.tobytes()], "floors": [floors.tobytes()]})

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})]
        for c in left.itertuples(index=False):
            held = Bucket(np.frombuffer(c.c_ids, np.int64), np.frombuffer(c.c, float).reshape(-1, width))
            for r in right.itertuples(index=False):
                own = np.frombuffer(r.q_ids, np.int64)
                at, ids, products = held.search(own, np.frombuffer(r.q, float).reshape(-1, width), np.frombuffer(r.floors, float), k)
                out.append(pd.DataFrame({"query_id": own[at], "vec_id": ids, "score": products}))
        return pd.concat(out)

    def met(queries: DataFrame, low: int, high: int) -> DataFrame:
        """The best products of the queries (id, v, floor) in buckets of these numbers."""
        block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))
        sides = saved(queries.withColumn("block", block).groupBy("block").applyInPandas(packed, "block long, need double, q_ids binary, q binary, floors binary"))
        numbers = F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long"))).alias("bucket")
        pairs = sides.select("block", "need", numbers).join(buckets.select("bucket", "top"), "bucket").filter("top >= need")
        pairs = pairs.select("bucket", "block", F.floor(F.col("block") / TOGETHER).alias("tile"))
        # both sides are dealt by (bucket, tile): as many keys as there are tasks' worth of work
        left = pairs.select("bucket", "tile").distinct().join(buckets, "bucket")
        right = pairs.join(sides.drop("need"), "block")
        right = right.select(F.col("bucket").alias("b"), F.col("tile").alias("t"), "q_ids", "q", "floors")
        return left.groupBy("bucket", "tile").cogroup(right.groupBy("b", "t")).applyInPandas(find, "query_id long, vec_id long, score long")

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = saved(met(asked.withColumn("floor", F.lit(None).cast("double")), first, first))
    if last > first:
        floors = best.withColumn("rank", rank).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
        best = best.unionByName(met(asked.join(floors, "id", "left"), first + 1, last))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
