"""Vectors of chunks: requests to embed them, records, and the table that holds them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.reference import EMBEDDED_CHARS, RECORD_CHARS, REQUEST_ITEMS, REQUEST_TOKENS
from quillstone.functions.text import blank_if_null, token_estimate


def packed(texts: DataFrame, group: str, order: str, tokens: int = REQUEST_TOKENS, items: int = REQUEST_ITEMS) -> DataFrame:
    """Add request: the number, within its group, of the request that a text goes with, in order.

    A request takes texts while their estimated tokens and their number stay within the bounds; a text that
    exceeds them alone is a request of its own. Texts are cut for the model, as it takes no longer ones.
    """
    cut = F.substring(blank_if_null(F.col("text")), 1, EMBEDDED_CHARS)
    rows = texts.withColumn("text", cut).withColumn("tokens", token_estimate(F.col("text")))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, number, used, held = None, 0, 0, 0
        for f in frames:
            numbers = []
            for g, n in zip(f[group], f["tokens"], strict=True):
                if g != at:
                    at, number, used, held = g, 0, 0, 0
                elif held and (used + n > tokens or held >= items):
                    number, used, held = number + 1, 0, 0
                used, held = used + n, held + 1
                numbers.append(number)
            yield f.assign(request=numbers)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(group).sortWithinPartitions(group, order).mapInPandas(walk, f"{schema}, request long")


def embedded(requests: DataFrame, embed: Callable[[list[str]], list[list[float]]], group: str, key: str = "chunk_id") -> DataFrame:
    """key, v: the vectors of packed texts. embed is called once a request, and gives a vector for each text in order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        return pd.DataFrame({key: rows[key], "v": embed(rows["text"].to_list())})

    return requests.groupBy(group, "request").applyInPandas(run, f"`{key}` {requests.schema[key].dataType.simpleString()}, v array<double>")


def records(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """id, values, metadata of each chunk with a vector: its columns but the bulky ones, strings cut, nulls left out."""
    kept = [f for f in chunks.schema if f.name not in (key, "table_rows") and f.dataType.simpleString() in ("string", "int", "bigint", "double", "boolean", "date")]
    value = lambda f: F.substring(f.name, 1, RECORD_CHARS) if f.dataType.simpleString() == "string" else F.col(f.name).cast("string")
    entries = F.array(*(F.struct(F.lit(f.name).alias("k"), value(f).alias("v")) for f in kept))
    metadata = F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))
    return chunks.join(vectors.select(key, F.col("v").alias("values")), key).select(F.col(key).alias("id"), "values", metadata.alias("metadata"))


def upserted(held: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The records held, with new ones in place of those of the same id; repeating it changes nothing."""
    return held.join(new.select(key).distinct(), key, "left_anti").unionByName(new.dropDuplicates([key]))
