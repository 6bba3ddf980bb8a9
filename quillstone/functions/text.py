"""Column expressions over text: words, blocks, chunks, ids, citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.reference import EXCERPT_CHARS, MAX_PASSAGE, STOPWORDS, TRUNCATED

LEAST_BLOCK = 40
CHILD_WORDS, PARENT_WORDS = 400, 1500


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def word_count(text: Column) -> Column:
    """Runs of anything but Unicode white space."""
    return F.regexp_count(blank_if_null(text), F.lit(r"(?U)\S+"))


def blocks(text: Column, least: int = LEAST_BLOCK) -> Column:
    """The lines of a text with at least so many characters."""
    return F.filter(F.split(blank_if_null(text), "\n"), lambda b: F.length(b) >= least)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What use makes of a value that is computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def greedy_chunks(parts: Column, words: int) -> Column:
    """Join blocks in order until a chunk has so many words; then begin the next. Blocks are never cut.

    A fold with a running sum that is reset, which no window function expresses. It keeps only where chunks end, as
    Spark copies what a fold keeps at every step; the chunks are sliced out afterwards.
    """
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def step(acc: Column, count: Column) -> Column:
        full, at = acc["n"] + count >= words, acc["at"] + 1
        return F.struct(F.when(full, F.lit(0)).otherwise(acc["n"] + count).alias("n"), at.alias("at"), F.when(full, F.concat(acc["ends"], F.array(at))).otherwise(acc["ends"]).alias("ends"))

    def finish(acc: Column) -> Column:
        last = F.coalesce(F.get(acc["ends"], F.size(acc["ends"]) - 1), F.lit(0))
        return F.when(acc["at"] > last, F.concat(acc["ends"], F.array(acc["at"]))).otherwise(acc["ends"])

    def sliced(blocks_: Column, ends: Column) -> Column:
        before = lambda k: F.when(k > 0, F.get(ends, k - 1)).otherwise(F.lit(0))
        return F.transform(ends, lambda end, k: F.array_join(F.slice(blocks_, before(k) + 1, end - before(k)), " "))

    return _once(parts, lambda p: _once(F.aggregate(F.transform(p, word_count), start, step, finish), lambda ends: sliced(p, ends)))


def chunk_id(*fields: Column) -> Column:
    """The first 32 hex digits of the SHA-256 of the fields, parted by bars; nulls are empty."""
    return F.substring(F.sha2(F.concat_ws("|", *(blank_if_null(f) for f in fields)), 256), 1, 32)


def table_text(headers: Column, rows: Column) -> Column:
    """A table as lines of cells parted by bars."""
    return F.array_join(F.transform(F.concat(F.array(headers), rows), lambda r: F.array_join(r, " | ")), "\n")


def citation(ticker: Column, form: Column, filed: Column, page: Column) -> Column:
    base = F.concat(F.lit("["), F.concat_ws(" ", ticker, form, filed))
    return F.concat(base, F.when(page.isNotNull(), F.concat(F.lit(" p."), page.cast("string"))).otherwise(""), F.lit("]"))


def passage_text(text: Column) -> Column:
    return F.when(F.length(text) > MAX_PASSAGE, F.concat(F.substring(text, 1, MAX_PASSAGE), F.lit(TRUNCATED))).otherwise(text)


def terms(text: Column, pattern: str = r"[\p{L}\p{N}]+") -> Column:
    """Lower-cased terms in order, repeats included."""
    return F.regexp_extract_all(F.lower(blank_if_null(text)), F.lit(pattern), F.lit(0))


def without_stopwords(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS))


def token_estimate(text: Column) -> Column:
    return (F.length(text) / 2).cast("int") + 1


def tidied(text: Column) -> Column:
    """A table's text for reading: cells parted by bars, without the numbers of its columns, blanks and repeats in a row."""
    cells = F.transform(F.split(F.translate(blank_if_null(text), "\u00a0", " "), r"\s*\|\s*|\n"), lambda c: F.trim(c))
    numbered = F.aggregate(cells, F.lit(0), lambda n, c: F.when((n >= 0) & (c == n.cast("string")), n + 1).when(n >= 0, -n - 1).otherwise(n))
    first = F.when(numbered >= 0, numbered).otherwise(-numbered - 1)
    filled = F.filter(F.slice(cells, first + 1, F.greatest(F.size(cells) - first, F.lit(0))), lambda c: c != "")
    return F.array_join(F.filter(filled, lambda c, i: (i == 0) | (c != F.get(filled, i - 1))), " | ")


def excerpt(text: Column, found: Column, most: int = EXCERPT_CHARS, before: int = 120) -> Column:
    """Part of a tidied text: from a little before the first of the figures found that it holds, else its beginning."""
    clean = tidied(text)
    number = lambda f: F.regexp_extract(f, r"\d[\d,.]*", 0)
    places = F.transform(found, lambda f: F.coalesce(F.nullif(F.position(number(f), clean), F.lit(0)), F.position(F.replace(number(f), F.lit(",")), clean)))
    at = F.coalesce(F.get(F.filter(F.zip_with(found, places, lambda f, p: F.when(number(f) != "", p).otherwise(0)), lambda p: p > 0), F.lit(0)) - 1, F.lit(0))
    start = F.greatest(at - before, F.lit(0))
    return F.concat(F.when(start > 0, "...").otherwise(""), F.substring(clean, start + 1, F.lit(most)))
