"""The keyword index: terms, postings, document and corpus statistics."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.stem import stemmed
from quillstone.functions.text import terms
from quillstone.session import names_in, remove
from quillstone.sources import manifests


def postings(units: DataFrame, key: str = "chunk_id", stem: bool = False) -> DataFrame:
    """term, key, tf. Terms are runs of letters and digits in lower case, stemmed on demand."""
    words = terms(F.col("text"))
    # outer: for a plain explode Spark would add a filter on the array, which builds the array twice
    each = units.select(key, F.explode_outer(words).alias("term")).filter("term IS NOT NULL")
    counts = each.groupBy("term", key).agg(F.count("*").alias("tf"))
    if not stem:
        return counts
    # stem the dictionary, not the occurrences
    words = counts.select("term").distinct().withColumn("stem", stemmed("term"))
    return counts.join(words, "term").groupBy(F.col("stem").alias("term"), key).agg(F.sum("tf").alias("tf"))


def statistics(posted: DataFrame, units: DataFrame, key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """(key, dl) and one row (n, avgdl). Units without terms count."""
    lengths = units.select(key).join(posted.groupBy(key).agg(F.sum("tf").alias("dl")), key, "left").select(key, F.coalesce("dl", F.lit(0)).alias("dl"))
    return lengths, lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


class Index(NamedTuple):
    """Postings (term, key, tf), lengths (key, dl) and one row of corpus statistics; whether terms are stems."""

    postings: DataFrame
    lengths: DataFrame
    corpus: DataFrame
    stem: bool


def made(units: DataFrame, key: str = "chunk_id", stem: bool = True) -> Index:
    """An index of the units that is not written anywhere."""
    posted = postings(units, key, stem)
    return Index(posted, *statistics(posted, units, key), stem)


def stemmed_terms(asked: DataFrame) -> DataFrame:
    """The terms (qid, term) of questions as an index of stems holds them: parted at underscores, folded and stemmed."""
    parts = asked.select("qid", F.explode(F.filter(F.split("term", "_"), lambda t: t != "")).alias("term"))
    return parts.select("qid", stemmed("term").alias("term")).distinct()


def write_index(units: DataFrame, path: str, key: str = "chunk_id", stem: bool = True) -> str:
    """Write a new version of the index, sorted by term, beside those that are there, and return its name.

    The corpus statistics are written last, and a reader takes the version of the newest ones: it sees a whole
    version, the former one until then. Older versions stay until `forget` removes them.
    """
    version = uuid.uuid4().hex
    posted = postings(units, key, stem)
    posted.repartitionByRange("term").sortWithinPartitions("term", key).write.parquet(f"{path}/postings/version={version}")
    posted = units.sparkSession.read.parquet(f"{path}/postings/version={version}")
    lengths, corpus = statistics(posted, units, key)
    lengths.write.parquet(f"{path}/lengths/version={version}")
    corpus.withColumns({"stem": F.lit(stem), "made": F.current_timestamp(), "version": F.lit(version)}).coalesce(1).write.mode("append").parquet(f"{path}/corpus")
    return version


def load(spark: SparkSession, path: str) -> Index:
    """The newest whole version of an index; a search for few terms reads few of its row groups."""
    corpus = spark.read.parquet(f"{path}/corpus")
    newest = corpus.orderBy(F.desc("made"), "version").first()
    read = lambda part: spark.read.parquet(f"{path}/{part}/version={newest['version']}")
    return Index(read("postings"), read("lengths"), corpus.filter(F.col("version") == newest["version"]).select("n", "avgdl"), newest["stem"])


def forget(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Remove what the versions but the newest `keep` wrote; returns their names. A version that is being written stays."""
    known = [r["version"] for r in spark.read.parquet(f"{path}/corpus").orderBy(F.desc("made"), "version").select("version").collect()]
    there = {x for part in ("postings", "lengths") for x in names_in(spark, f"{path}/{part}")}
    gone = [v for v in known[max(1, keep) :] if f"version={v}" in there]
    for version in gone:
        for part in ("postings", "lengths"):
            remove(spark, f"{path}/{part}/version={version}")
    return gone


LOOKUP = "kind string, name string"


def lookup_tables(units: DataFrame, path: str, key: str = "chunk_id") -> int:
    """Publish what answers without a search: the texts by key, sorted so that a few ids read few row groups, and the coverage.

    Both switch at once, by a manifest; `manifests.forget` removes former ones.
    """
    spark, name = units.sparkSession, uuid.uuid4().hex
    held = units.dropDuplicates([key])
    held.repartitionByRange(key).sortWithinPartitions(key).write.parquet(f"{path}/lookup/{name}/units")
    units.groupBy("ticker", "form", "filed").agg(F.count("*").alias("chunks")).write.parquet(f"{path}/lookup/{name}/coverage")
    return manifests.commit(spark, path, [("lookup", name)], LOOKUP)


def by_ids(spark: SparkSession, path: str, ids: list[str], key: str = "chunk_id") -> DataFrame:
    """The units with these ids; unknown ids are absent."""
    name = manifests.entries(spark, path, LOOKUP)[0]["name"]
    return spark.read.parquet(f"{path}/lookup/{name}/units").filter(F.col(key).isin(ids))


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """The coverage that was published with the units."""
    name = manifests.entries(spark, path, LOOKUP)[0]["name"]
    return spark.read.parquet(f"{path}/lookup/{name}/coverage")
