"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.session import remove as removed
from quillstone.session import saved
from quillstone.session import shared_folder as checkpoint_folder

__all__ = ["checkpoint_folder", "removed", "saved"]  # what the operators take from here besides the functions below

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.struct(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"))


def columns_of(docs: DataFrame, *without: str) -> list[str]:
    """The names of the columns but for some, whatever their case."""
    return [c for c in docs.columns if c.lower() not in without]


def held(columns: list[str]) -> Column:
    """The columns as one, named row: whatever they are called, they clash with no other."""
    return F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")


def released(columns: list[str], **new: Column) -> list[Column]:
    """The columns that `held` took, some of them replaced."""
    return [new.get(c, F.col("row").getField(c)).alias(c) for c in columns]


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once a row: Spark moves no filter on it below a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def words(text: Column) -> Column:
    """The words of a text; an empty array if there are none."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and leave every other character."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether the table has at most so many rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Mark a side for broadcast if it is within the bound; leave the choice to Spark otherwise."""
    return F.broadcast(df) if small_enough(df, rows) else df
