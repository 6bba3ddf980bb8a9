"""Nearest vectors by cosine without scoring all pairs: pivots and the triangle inequality of angles.

Vectors are placed once: each in the cell of its nearest pivot, and there in a ring of angles to that pivot. Two
facts bound the cosine of a query to all vectors of a ring: the angle between them is at least the difference of
their angles to the pivot, and a cell lies on its own side of the plane between its pivot and every other. A search
scores the rings that may be nearest until they hold enough vectors, and then only those whose bound reaches the
score of the last of them. Bounds are compared with a margin, so the result is that of scoring all pairs.

Pivots come from a bounded sample; which ones they are decides how much is skipped and never what is found. Vectors
that lie in groups are skipped well, random ones of many dimensions hardly at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.retrieve import PLACES, top_ranked
from quillstone.session import saved

#: Pivots, the vectors that they are chosen from, and the rings of each cell: at most PIVOTS * (RINGS + 1) rings in all.
PIVOTS, SAMPLE, RINGS = 64, 4096, 32
#: Questions that travel in one row, and vectors of a ring in one part.
QUESTION_BLOCK, PART_ROWS = 64, 100_000
#: Scores are rounded to PLACES, so a bound that is lower by this much cannot reach the last rank.
MARGIN = 2 * 10.0**-PLACES


class Placed(NamedTuple):
    """units: key, v, n (length), cell, ring, angle. pivots: cell, p (of length 1)."""

    units: DataFrame
    pivots: DataFrame

    def write(self, path: str) -> None:
        self.units.write.parquet(f"{path}/units")
        self.pivots.write.parquet(f"{path}/pivots")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Placed:
        return Placed(spark.read.parquet(f"{path}/units"), spark.read.parquet(f"{path}/pivots"))


def _measured(vectors: DataFrame, key: str) -> DataFrame:
    """key, v, n of the vectors that have a cosine: none that is null, of length 0 or not finite."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    out = vectors.select(key, F.col("v").cast("array<double>").alias("v"), length.alias("n"))
    return out.filter((F.col("n") > 0) & (F.col("n") < float("inf")))


def _spread(sample: np.ndarray, most: int) -> np.ndarray:
    """Rows that are far from each other: each the one whose nearest pivot so far is the farthest."""
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(most, len(sample)):
        at = int(nearest.argmin())
        if nearest[at] > 1 - 1e-9:
            break
        chosen.append(at)
        nearest = np.maximum(nearest, sample @ sample[at])
    return sample[chosen]


def _pivots(placed: DataFrame) -> np.ndarray:
    return np.array([r["p"] for r in placed.orderBy("cell").collect()])


def place(vectors: DataFrame, key: str = "chunk_id", pivots: int = PIVOTS) -> Placed:
    """Place vectors (key, v), all of the same number of dimensions. Those without a cosine are left out.

    Every search reads the units several times: write them, or save them, first.
    """
    measured = _measured(vectors, key)
    sample = [r["v"] for r in measured.orderBy(F.xxhash64(key), key).limit(SAMPLE).select("v").collect()]
    unit = np.array(sample, float)
    unit = _spread(unit / np.linalg.norm(unit, axis=1, keepdims=True), pivots) if sample else unit

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if len(d):
                cosines = np.stack(d["v"].to_list()) / d["n"].to_numpy()[:, None] @ unit.T
                angle = np.arccos(np.clip(cosines.max(axis=1), -1, 1))
                ring = np.floor(angle / np.pi * RINGS).astype(np.int32)
                yield d.assign(cell=cosines.argmax(axis=1).astype(np.int32), ring=ring, angle=angle)

    kind = measured.schema[key].dataType.simpleString()
    units = measured.mapInPandas(run, f"`{key}` {kind}, v array<double>, n double, cell int, ring int, angle double")
    rows = [(i, p.tolist()) for i, p in enumerate(unit)]
    return Placed(units, vectors.sparkSession.createDataFrame(rows, "cell int, p array<double>"))


def _bounding(pivots: np.ndarray, rings: pd.DataFrame, k: int):
    """From (qid, v, n) to (qid, v, n, cell, ring, most, first): a bound for every ring, and whether it is scored first."""
    cell, low, high, count = (rings[c].to_numpy() for c in ("cell", "low", "high", "count"))
    apart = np.linalg.norm(pivots[:, None] - pivots[None], axis=2) + np.eye(len(pivots))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for qid, v, n in zip(d["qid"], d["v"], d["n"], strict=True):
                cosines = np.clip(pivots @ (v / n), -1, 1)
                angle = np.arccos(cosines)[cell]
                most = np.cos(np.maximum(0, np.maximum(angle - high, low - angle)))
                # how far the query is beyond the plane between a cell's pivot and another
                beyond = ((cosines[None] - cosines[:, None]) / apart).max(axis=1).clip(0, 1)
                most = np.minimum(most, np.sqrt(1 - beyond**2)[cell])
                order = np.argsort(-most, kind="stable")
                first = np.zeros(len(most), bool)
                first[order[: 1 + np.searchsorted(np.cumsum(count[order]), k)]] = True
                yield pd.DataFrame({"qid": qid, "cell": cell, "ring": rings["ring"].to_numpy(), "most": most, "first": first})

    return run


def _scores(visits: DataFrame, queries: DataFrame, units: DataFrame, blocks: int, key: str) -> DataFrame:
    """qid, key, score of the units in the rings that each query visits. visits: qid, cell, ring, parts."""
    asked = visits.join(queries, "qid").withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    # a block's hash may meet more questions than others: they are few, as blocks are counted by QUESTION_BLOCK
    rows = asked.groupBy("cell", "ring", "block").agg(F.first("parts").alias("parts"), F.collect_list(F.struct("qid", "v", "n")).alias("asked"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    met = units.select(key, "v", "n", "cell", "ring", "part").join(rows, ["cell", "ring", "part"])
    met = met.select(key, "v", "n", F.explode("asked").alias("q"))
    dot: Column = F.aggregate(F.zip_with("v", "q.v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return met.select(F.col("q.qid").alias("qid"), key, F.round(dot / (F.col("n") * F.col("q.n")), PLACES).alias("score"))


def scored(queries: DataFrame, placed: Placed, k: int = 10, key: str = "chunk_id") -> DataFrame:
    """qid, key, score of pairs among which are the k best of each query (qid, v).

    Filter the units of `placed` before: bounds and counts are then of what is left. qid is unique. Only rings'
    bounds and pivots, both of fixed number, come to the driver.
    """
    spark = queries.sparkSession
    asked = _measured(queries, "qid")
    found = placed.units.groupBy("cell", "ring").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("count"))
    rings = found.orderBy("cell", "ring").toPandas()
    n = asked.count()
    kinds = f"qid {asked.schema['qid'].dataType.simpleString()}, `{key}` {placed.units.schema[key].dataType.simpleString()}, score double"
    if rings.empty or not n:
        return spark.createDataFrame([], kinds)
    rings["parts"] = -(-rings["count"] // PART_ROWS)
    parts = F.broadcast(spark.createDataFrame(rings[["cell", "ring", "parts"]]).select(F.col("cell").cast("int"), F.col("ring").cast("int"), "parts"))
    kind = asked.schema["qid"].dataType.simpleString()
    bounds = asked.mapInPandas(_bounding(_pivots(placed.pivots), rings, k), f"qid {kind}, cell int, ring int, most double, first boolean").join(parts, ["cell", "ring"])
    units = placed.units.join(parts, ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")))
    blocks = -(-n // QUESTION_BLOCK)
    start = _scores(bounds.filter("first"), asked, units, blocks, key)
    start = saved(top_ranked(start, k, key).select("qid", key, "score"))
    reached = start.groupBy("qid").agg(F.count("*").alias("held"), F.min("score").alias("floor"))
    enough = F.when(F.col("held") >= k, F.col("most") >= F.col("floor") - MARGIN).otherwise(True)
    rest = bounds.filter("not first").join(reached, "qid").filter(enough)
    return start.unionByName(_scores(rest.select("qid", "cell", "ring", "parts"), asked, units, blocks, key))


def nearest(queries: DataFrame, placed: Placed, k: int = 10, key: str = "chunk_id") -> DataFrame:
    """qid, key, score, rank: the k nearest placed vectors of each query (qid, v), as `retrieve.cosine` ranks them.

    Ties in the rounded score go by key. Null vectors, those of length 0 and those that are not finite take no part,
    as queries and as units. Fewer than k units give fewer ranks; without units or queries the result is empty.
    """
    return top_ranked(scored(queries, placed, k, key), k, key).select("qid", key, "score", "rank")
