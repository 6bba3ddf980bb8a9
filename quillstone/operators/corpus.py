"""A corpus of chunks that is published by commit: staged parts, a guard, and a manifest that switches readers.

chunks have ticker, form and filed and any other columns. Each part is Parquet partitioned by ticker. The coverage
(ticker, form, filed, chunks) of every version is kept beside it, and a new version must cover all that the one
before covered and all that came, as the files that it lists are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.service import new_filings, publishable
from quillstone.session import remove
from quillstone.sources import manifests

ENTRY = "kind string, name string, source string, batch long"
COVERAGE = "ticker string, form string, filed string, chunks long"


def _parts(rows: list, kind: str = "part") -> list[str]:
    return [r[1] for r in rows if r[0] == kind]


def _read(spark: SparkSession, path: str, names: list[str]) -> DataFrame | None:
    out = None
    for name in names:
        one = spark.read.option("basePath", f"{path}/parts/{name}").parquet(f"{path}/parts/{name}")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The chunks of the newest version, or of a given one; None if nothing was published."""
    return _read(spark, path, _parts(manifests.entries(spark, path, ENTRY, version)))


def coverage(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """What a version covers, as it was when it was published."""
    names = _parts(manifests.entries(spark, path, ENTRY, version), "coverage")
    return spark.read.schema(COVERAGE).parquet(*(f"{path}/coverage/{x}" for x in names)) if names else spark.createDataFrame([], COVERAGE)


def covered(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("ticker", "form", "filed").agg(F.count("*").alias("chunks"))


def _published(spark: SparkSession, path: str, parts: list, wanted: DataFrame, source: str, batch: int) -> int:
    """Commit the parts if they cover what is wanted; otherwise remove nothing, commit nothing and raise."""
    chunks = _read(spark, path, _parts(parts))
    name = uuid.uuid4().hex
    covered(chunks).write.parquet(f"{path}/coverage/{name}")
    lacking = publishable(wanted, spark.read.schema(COVERAGE).parquet(f"{path}/coverage/{name}"))
    if n := lacking.count():
        remove(spark, f"{path}/coverage/{name}")
        raise ValueError(f"the new corpus lacks {n} filings; the former one stays")
    return manifests.commit(spark, path, [*parts, ("coverage", name, source, batch)], ENTRY)


def add(filings: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], source: str = "", batch: int = 0) -> int | None:
    """Publish new filings (ticker, form, filed, ok, ...) as build makes chunks of them; None if nothing changes.

    Only filings on dates that the ticker lacks are built. A ticker with a filing that is not ok is left as it is,
    and the others go on. A source and batch that the corpus has taken already add nothing, so a batch may be
    replayed. If the chunks lack a filing that came, or the files that are held lack one that was covered, nothing
    is published.
    """
    spark = filings.sparkSession
    rows = manifests.entries(spark, path, ENTRY)
    if source and any(r["kind"] in ("part", "held") and r["source"] == source and r["batch"] == batch for r in rows):
        return None
    bad = filings.groupBy("ticker").agg(F.every(F.coalesce("ok", F.lit(False))).alias("ok")).filter("NOT ok")
    held = coverage(spark, path)
    new = new_filings(filings.join(bad, "ticker", "left_anti").drop("ok"), held)
    if new.isEmpty():
        return None
    name = uuid.uuid4().hex
    build(new).write.partitionBy("ticker").parquet(f"{path}/parts/{name}")
    wanted = held.select("ticker", "form", "filed").unionByName(new.select("ticker", "form", "filed"))
    parts = [tuple(r) for r in rows if r["kind"] in ("part", "held")]
    return _published(spark, path, [*parts, ("part", name, source, batch)], wanted, source, batch)


def compact(spark: SparkSession, path: str) -> int | None:
    """Publish all parts as one; None if they are one already. The batches that they hold stay known."""
    rows = manifests.entries(spark, path, ENTRY)
    parts = [r for r in rows if r["kind"] in ("part", "held")]
    if len(_parts(rows)) < 2:
        return None
    name = uuid.uuid4().hex
    _read(spark, path, _parts(rows)).repartition("ticker", "filed").write.partitionBy("ticker").parquet(f"{path}/parts/{name}")
    last = parts[-1]
    # one row for each batch, all of the same part
    taken = [("part", name, last["source"], last["batch"]), *(("held", name, r["source"], r["batch"]) for r in parts[:-1])]
    return _published(spark, path, taken, coverage(spark, path), last["source"], last["batch"])


def forget(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Remove all versions but the newest `keep` and what no version that is left names."""
    return manifests.forget(spark, path, ENTRY, ("parts", "coverage"), keep)
