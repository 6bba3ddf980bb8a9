"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of letters and digits, and runs of other signs; case counts. A document's features are its
single words and pairs of neighbours, hashed into 2^BITS weights and weighted by their share of the document,
so that a score does not depend on length. Scores are sparse dot products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import held, released, text_of

TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
BITS = 18
#: Training uses at most so many labelled documents, those with the smallest hashes of their ids.
MAX_TRAIN = 12_000
SHARDS = 8
EPOCHS = 3
GAIN = 32.0
THRESHOLD = 0.7


def token_hashes(text: Column) -> Column:
    """The words of the text as 32-bit hashes."""
    return F.transform(F.regexp_extract_all(text_of(text), F.lit(TOKEN), F.lit(0)), lambda t: F.hash(t))


def buckets(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The buckets of all words and pairs of neighbours; a pair of equal words counts as one feature."""
    h = hashes.astype(np.uint32)
    pairs = (h[:-1] * np.uint32(0x9E3779B1)) ^ (h[1:] * np.uint32(0x85EBCA77))
    pairs[h[:-1] == h[1:]] = np.uint32(0xA5A5A5A5)
    mixed = np.concatenate([h * np.uint32(0xC2B2AE3D), pairs * np.uint32(0x27D4EB2F)])
    return (mixed >> np.uint32(32 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Follow:
    """FTRL-proximal settings."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1


def train(rows: pd.DataFrame, settings: Follow, epochs: int, bits: int = BITS) -> pd.DataFrame:
    """Fit one shard: columns order, label, hashes. Returns the weights that are not 0; bucket -1 is the bias."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    rows = rows.sort_values("order", kind="stable")
    data = []
    for label, hashes in zip(rows["label"], rows["hashes"], strict=True):
        at, count = np.unique(buckets(np.asarray(hashes), bits), return_counts=True)
        x = GAIN * count / max(1, count.sum())
        data.append((float(label), np.append(at, size - 1), np.append(x, 1.0)))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = -(zi - np.sign(zi) * settings.l1) / ((settings.beta + np.sqrt(ni)) / settings.alpha + settings.l2)
        return np.where(np.abs(zi) <= settings.l1, 0.0, w)

    for _ in range(epochs):
        for label, at, x in data:
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / settings.alpha * w
            n[at] = ni + g * g
    w = weights(z, n)
    used = np.nonzero(w)[0]
    return pd.DataFrame({"bucket": np.where(used == size - 1, -1, used), "weight": w[used]})


def fit(docs: DataFrame, labels: DataFrame, settings: Follow = Follow(), epochs: int = EPOCHS, shards: int = SHARDS, most: int = MAX_TRAIN) -> np.ndarray | None:
    """Fit on labelled documents whose crc32(doc_id as text) mod 4 is not 2; None if there are none.

    At most `most` labelled ids are used, by the order of a hash. They are dealt to `shards` models, whose
    weights are averaged: 2^BITS + 1 numbers at most, the last being the bias. Null labels are left out; a
    doc_id with several labels counts with the largest; of the texts that share a doc_id the one with the least
    hash is used, so the bound holds for texts too.
    """
    usable = labels.filter((F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & F.col("quality").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("label")).withColumn("order", F.xxhash64("doc_id"))
    picked = usable.orderBy("order", "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "order", "label").agg(F.min_by(text_of("text"), F.xxhash64("text")).alias("text"))
    rows = rows.select(F.pmod("order", F.lit(shards)).alias("shard"), "order", "label", token_hashes(F.col("text")).alias("hashes"))
    parts = rows.groupBy("shard").applyInPandas(lambda d: train(d, settings, epochs), "bucket long, weight double")
    mean = parts.groupBy("bucket").agg((F.sum("weight") / shards).alias("weight")).toPandas()
    if mean.empty:
        return None
    out = np.zeros((1 << BITS) + 1, dtype=np.float64)
    out[mean["bucket"].to_numpy()] = mean["weight"].to_numpy()
    return out


def score(docs: DataFrame, model: np.ndarray | None, name: str = "score") -> DataFrame:
    """Add the score, from 0 to 1, of each row's whole text.

    Null and empty texts get the score of the bias alone; without a model all scores are 0.5. Rows that
    repeat score alike. A column named like the score is replaced.
    """
    if model is None:
        return docs.withColumn(name, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = shared.value
        for batch in batches:
            flat, ends = batch.flatten().to_numpy(zero_copy_only=False), batch.value_lengths().to_numpy(zero_copy_only=False).cumsum()
            out, start = np.empty(len(ends)), 0
            for i, end in enumerate(ends):
                found = w[buckets(flat[start:end])]
                out[i] = w[-1] + (GAIN * found.mean() if len(found) else 0.0)
                start = end
            yield pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return docs.withColumn(name, scores(token_hashes(F.col("text"))))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by a model fitted on the labels.

    Texts of any length are scored whole, null ones as empty. Rows that repeat score alike. Other columns are
    ignored. An empty table gives an empty result.
    """
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, unchanged; all of them if there is nothing to learn from."""
    model = fit(docs, labels)
    if model is None:
        return docs
    rows = score(docs.select(held(docs.columns), "text"), model).filter(F.col("score") >= threshold)
    return rows.select(*released(docs.columns))
