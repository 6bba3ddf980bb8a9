"""Versions of a folder: what a version consists of is listed in a manifest, and writing that is the commit.

Parts are written first, each into a folder of a new name, and never changed. A manifest is one file in a folder
of its own, so that readers, who take the newest whole one, see a change at once or not at all; what was written
by a run that broke off is named by no manifest. One writer at a time is assumed.
"""

from __future__ import annotations

from pyspark.sql import Row, SparkSession

from quillstone.session import names_in, remove


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that are whole, oldest first."""
    names = [x for x in names_in(spark, f"{path}/manifests") if x.startswith("version=")]
    return sorted(int(x.split("=")[1]) for x in names if "_SUCCESS" in names_in(spark, f"{path}/manifests/{x}"))


def entries(spark: SparkSession, path: str, schema: str, version: int | None = None) -> list[Row]:
    """What a version, or the newest, consists of; nothing if there is no such version. A few rows for each change."""
    known = versions(spark, path)
    version = (known[-1] if known else 0) if version is None else version
    return spark.read.schema(schema).parquet(f"{path}/manifests/version={version}").collect() if version in known else []


def commit(spark: SparkSession, path: str, rows: list, schema: str) -> int:
    """Make these rows the newest version, and return it. Numbers of manifests that were not finished are passed over."""
    taken = [int(x.split("=")[1]) for x in names_in(spark, f"{path}/manifests") if x.startswith("version=")]
    version = max([0, *taken]) + 1
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/manifests/version={version}")
    return version


def forget(spark: SparkSession, path: str, schema: str, parts: tuple[str, ...], keep: int = 1) -> list[str]:
    """Remove all versions but the newest `keep`, and the folders in `parts` that none of these names.

    Rows name folders in the column name. Returns what was removed. Not to be run beside a writer, whose parts no
    version names yet.
    """
    known = versions(spark, path)
    kept = known[-max(1, keep) :]
    named = {r["name"] for v in kept for r in entries(spark, path, schema, v)}
    gone = [f"manifests/{x}" for x in names_in(spark, f"{path}/manifests") if x not in {f"version={v}" for v in kept}]
    gone += [f"{part}/{x}" for part in parts for x in names_in(spark, f"{path}/{part}") if x not in named]
    for folder in gone:
        remove(spark, f"{path}/{folder}")
    return gone
