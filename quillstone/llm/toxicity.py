"""Toxicity classifier: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits, lower-cased. A document's features are its words, its pairs of neighbours
and its pairs with one or two words between (skip-grams), each hashed into 2^BITS weights and present or not:
a few toxic words count the same in a long text as in a short one. Every weight has its own learning rate, and
the L1 term keeps all weights at 0 that the labels do not carry clearly; the few others are broadcast as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import text_of
from quillstone.llm.hashing import ODD, mix

TOKEN = r"[\p{L}\p{N}]+"
BITS = 22
#: Words between the two of a pair, plus one.
GAPS = (1, 2, 3)
#: Training uses at most so many labelled documents, those with the smallest hashes of their ids.
MAX_TRAIN = 10_000
EPOCHS = 8
THRESHOLD = 0.7


@dataclass(frozen=True)
class Follow:
    """FTRL-proximal settings; a toxic document counts `rare` times, as there are few."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.01
    rare: float = 2.0


def token_hashes(text: Column) -> Column:
    """The words of the text as 32-bit hashes."""
    return F.transform(F.regexp_extract_all(F.lower(text_of(text)), F.lit(TOKEN), F.lit(0)), lambda t: F.hash(t))


def features(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The buckets of all words and pairs, with repeats."""
    h = hashes.astype(np.uint32).astype(np.uint64)
    parts = [mix(h + np.uint64(1))]
    parts += [mix(h[:-gap] * np.uint64(ODD) + h[gap:] * np.uint64(3) + np.uint64(gap)) for gap in GAPS if len(h) > gap]
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int32)


def train(rows: pd.DataFrame, settings: Follow = Follow(), epochs: int = EPOCHS, bits: int = BITS) -> pd.DataFrame:
    """Fit one model: columns order, label, hashes. Returns the weights that are not 0; bucket -1 is the bias."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    rows = rows.sort_values("order", kind="stable")
    data = [(float(y), np.append(np.unique(features(np.asarray(h), bits)), np.int32(size - 1))) for y, h in zip(rows["label"], rows["hashes"], strict=True)]

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = -(zi - np.sign(zi) * settings.l1) / ((settings.beta + np.sqrt(ni)) / settings.alpha + settings.l2)
        return np.where(np.abs(zi) <= settings.l1, 0.0, w)

    for _ in range(epochs):
        for label, at in data:
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * (settings.rare if label else 1.0)
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / settings.alpha * w
            n[at] = ni + g * g
    w = weights(z, n)
    used = np.nonzero(w)[0]
    return pd.DataFrame({"bucket": np.where(used == size - 1, -1, used), "weight": w[used]})


def fit(docs: DataFrame, labels: DataFrame, settings: Follow = Follow(), epochs: int = EPOCHS, most: int = MAX_TRAIN) -> pd.DataFrame | None:
    """Fit on labelled documents whose crc32(doc_id as text) mod 3 is not 1; None if there are none.

    At most `most` labelled ids are used, by the order of a hash, in one task. Null labels are left out; a doc_id
    with several labels counts with the largest; of the texts that share a doc_id the one with the least hash is
    used, so the bound holds for texts too. The weights are as few as L1 leaves, 2^BITS + 1 at most.
    """
    usable = labels.filter((F.crc32(F.col("doc_id").cast("string")) % 3 != 1) & F.col("toxic").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("label")).withColumn("order", F.xxhash64("doc_id"))
    picked = usable.orderBy("order", "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "order", "label").agg(F.min_by(text_of("text"), F.xxhash64("text")).alias("text"))
    rows = rows.select(F.lit(0).alias("one"), "order", "label", token_hashes(F.col("text")).alias("hashes"))
    model = rows.groupBy("one").applyInPandas(lambda d: train(d, settings, epochs), "bucket long, weight double").toPandas()
    return None if model.empty else model


def score(docs: DataFrame, model: pd.DataFrame | None, name: str = "score") -> DataFrame:
    """Add the score, from 0 to 1, of each row's whole text.

    Null and empty texts get the score of the bias alone; without a model all scores are 0.5. Rows that repeat
    score alike. A column named like the score is replaced.
    """
    if model is None:
        return docs.withColumn(name, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast((model["bucket"].to_numpy(), model["weight"].to_numpy()))

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at, weight = shared.value
        w = np.zeros((1 << BITS) + 1, np.float64)
        w[at] = weight  # the bias, -1, is the last
        used = w != 0
        for batch in batches:
            flat, ends = batch.flatten().to_numpy(zero_copy_only=False), batch.value_lengths().to_numpy(zero_copy_only=False).cumsum()
            out, start = np.empty(len(ends)), 0
            for i, end in enumerate(ends):
                found = features(flat[start:end])
                out[i] = w[-1] + w[np.unique(found[used[found]])].sum()
                start = end
            yield pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return docs.withColumn(name, scores(token_hashes(F.col("text"))))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by a model fitted on the labels.

    Texts of any length are scored whole, null ones as empty. Rows that repeat score alike; a null doc_id is not
    held out. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
