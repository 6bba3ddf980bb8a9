"""From a table of companies to chunks, in one call: numbers, listings, documents, blocks and tables, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.chunks import filing_chunks
from quillstone.operators.pages import page_parts
from quillstone.sources.filings import company_numbers, first_per_form, listing

#: Filings of each form that are taken, newest first.
LIMITS = {"10-Q": 4, "10-K": 2}


def wanted_filings(companies: DataFrame, live: DataFrame, overrides: DataFrame, submissions: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """ticker, cik, form, filed, accession and document of the filings to take of each company (ticker); see `filings`.

    A company without a number or without such filings is one row with nulls.
    """
    known = company_numbers(companies.select("ticker").distinct(), live, overrides)
    rows = first_per_form(listing(submissions), limits or LIMITS).select("cik", "form", "filed", "accession", "document")
    return known.join(rows, "cik", "left").select("ticker", "cik", "form", "filed", "accession", "document")


def ingested(wanted: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of the wanted filings, from documents (cik, accession, html), and an error row (ticker, form, filed, error)
    for each that cannot be had.

    A company with an error gives no chunks, and the others go on. Documents are parsed once.
    """
    found = wanted.join(documents.select("cik", "accession", "html"), ["cik", "accession"], "left")
    why = F.when(F.col("cik").isNull(), "unknown company").when(F.col("form").isNull(), "no filings").when(F.col("html").isNull(), "no document")
    found = found.withColumn("error", why)
    errors = found.filter("error IS NOT NULL").select("ticker", "form", "filed", "error")
    good = found.join(errors.select("ticker").distinct(), "ticker", "left_anti")
    row = F.struct("ticker", "form", "filed", F.col("accession").alias("doc_id"))
    parts = page_parts(good.select(row.alias("of"), "html"), "of")
    lines = F.transform("blocks", lambda b: F.regexp_replace(b, "\\s+", " "))
    filings = parts.select("of.*", F.array_join(lines, "\n").alias("text"))
    tables = parts.select("of.*", F.explode("tables").alias("t")).select("ticker", "form", "filed", "t.headers", "t.rows")
    return filing_chunks(filings, tables), errors
