"""From filings to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import CHILD_WORDS, PARENT_WORDS, blocks, chunk_id, greedy_chunks, table_text, word_count


def text_blocks(filings: DataFrame) -> DataFrame:
    """doc_id, ticker, form, filed, pos, block: the blocks of each filing's text."""
    return filings.select("doc_id", "ticker", "form", "filed", F.posexplode(blocks(F.col("text"))).alias("pos", "block"))


def chunks(filings: DataFrame, kind: str = "child") -> DataFrame:
    """The greedy chunks of each filing, numbered in order, with content-addressed ids."""
    size = {"child": CHILD_WORDS, "parent": PARENT_WORDS}[kind]
    out = filings.select("doc_id", "ticker", "form", "filed", F.posexplode(greedy_chunks(blocks(F.col("text")), size)).alias("nth", "text"))
    return out.select(chunk_id(F.col("ticker"), F.col("form"), F.col("filed"), F.lit(kind), F.lit("body"), F.col("text")).alias("chunk_id"), "*", F.lit(kind).alias("chunk_type"), word_count(F.col("text")).cast("int").alias("words"))


def table_chunks(tables: DataFrame) -> DataFrame:
    """Chunks of tables (headers, rows): the cells as text, with the structure kept."""
    text = table_text(F.col("headers"), F.col("rows"))
    out = tables.withColumn("text", text)
    key = chunk_id(F.col("ticker"), F.col("form"), F.col("filed"), F.lit("table"), F.lit("table"), F.col("text"))
    return out.select(key.alias("chunk_id"), "ticker", "form", "filed", "text", F.lit("table").alias("chunk_type"), F.col("headers").alias("table_headers"), F.col("rows").alias("table_rows"))


def filing_chunks(filings: DataFrame, tables: DataFrame) -> DataFrame:
    """Parents, children and tables of filings in one table."""
    text = chunks(filings, "parent").unionByName(chunks(filings, "child"))
    return text.unionByName(table_chunks(tables), allowMissingColumns=True)


def merged(existing: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Existing rows and the new ones whose key is not held; of new rows with one key one is taken."""
    return existing.unionByName(new.dropDuplicates([key]).join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def coverage(chunk_rows: DataFrame) -> DataFrame:
    return chunk_rows.groupBy("ticker", "form", "filed").agg(F.count("*").alias("chunks"))


def covered_companies(cover: DataFrame) -> DataFrame:
    """For each ticker and form the first and last filing date and the number of filings."""
    return cover.groupBy("ticker", "form").agg(F.min("filed").alias("first_filed"), F.max("filed").alias("last_filed"), F.countDistinct("filed").alias("filings"))


def nested_companies(cover: DataFrame) -> DataFrame:
    """ticker -> form -> struct(first_filed, last_filed, filings)."""
    flat = covered_companies(cover)
    return flat.groupBy("ticker").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("form", F.struct("first_filed", "last_filed", "filings").alias("filed"))))).alias("forms"))


def corpus_totals(chunk_rows: DataFrame) -> DataFrame:
    """Companies, filings and chunks, over all forms and by form, in one pass."""
    filing = F.struct("ticker", "form", "filed")
    made = chunk_rows.withColumn("filing", filing).cube("form")
    return made.agg(F.countDistinct("ticker").alias("companies"), F.countDistinct("filing").alias("filings"), F.count("*").alias("chunks"))
