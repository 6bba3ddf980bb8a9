"""A corpus pipeline: each stage writes its documents as Parquet, and the next one reads them.

Every stage takes nulls in any column, empty and very long texts, repeated rows and further columns of any
names as the operator that it calls defines them, and gives an empty table for an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import contamination, copies, lines, mixing, quality
from quillstone.llm.common import checkpoint_folder, columns_of, held, removed, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts. A model is fitted on the labels of these documents.

    Null texts score as empty ones; see `quality`.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with lines that came before removed; those that lose all their text go.

    n_chars is set anew where lines were removed. Null texts stay as they are.
    """
    # the counts that the operator adds replace columns of docs with their names: those are held back
    own = columns_of(docs, "doc_id", "text", "n_chars")
    out = lines.deduplicate(docs.select("doc_id", "text", "n_chars", held(own)))
    changed = F.col("n_removed") > 0
    out = out.filter(~(changed & (F.length("text") == 0)))
    n_chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select(*({"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": n_chars.alias("n_chars")}.get(c, F.col("row").getField(c).alias(c)) for c in docs.columns))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near-copies.

    Near-copies share 0.8 of their five-word shingles. Candidates are texts whose SimHashes, as op6 makes them, link
    within four bits, and those that MinHash bands find beyond that; an exact check of the share follows.
    """
    return copies.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no benchmark item."""
    return contamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, with size, source_size, target, copies and taken.

    Rows that share a doc_id take the copies that were dealt to that id in order of their text.
    """
    return mixing.taken(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixture", source_mixture),
]

#: Classification, fingerprints and random rounding are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents. Results between stages go to the folder that the session shares, and are
    deleted once the stage after them is written; those before the last stage stay, as its result reads them."""
    docs, at, before = table(spark, sf_dir, "documents"), f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for number, (name, stage) in enumerate(STAGES, 1):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES):
            return out
        out.write.parquet(folder := f"{at}/{number}-{name}")
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return docs
