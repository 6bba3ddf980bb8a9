"""A keyword index that grows by segments: units are added, deleted and merged without building the rest anew.

A segment is never changed. Its units are numbered in order of their attributes, SLAB numbers are a slab, and its
postings are one row for each term and slab, with the largest tf and the smallest length among them. These two
bound every score of the slab, whatever the corpus's statistics become, so a search reads the arrays of postings
only where the bound reaches the k-th best score found so far, and only in slabs that the filters leave. A slab's
arrays meet in one group, with the questions that want it, and only its best units leave it. Files of postings hold
whole slabs, sorted by term, so that sums over a slab's terms are made where they are read.

The segments and deletions that make up the index are listed in a manifest, a new one for each change (see
`manifests`). Frequencies, lengths and numbers of units are sums over segments, less those of the units deleted.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.operators.index import postings
from quillstone.operators.retrieve import BROADCAST_TERMS, K1, LEAST_IDF, PLACES, QUESTION_BLOCK, B
from quillstone.session import remove, saved
from quillstone.sources import manifests

SLAB = 128
#: At least so many slabs of a question are scored first, for the score that others must reach.
FIRST = 4
#: So many rows of keys are broadcast at most.
SIDE_ROWS = 500_000
ENTRY = "kind string, name string, n long, dl long, stem boolean, key string, attributes array<string>"


class Segments(NamedTuple):
    """An index as one manifest lists it.

    blocks: segment, slab, term, n, max_tf, min_dl, posts (array of key, tf, dl). units: segment, slab, key, dl and
    the attributes, deleted ones included. gone (segment, slab, key) and gone_terms (term, df) of the units deleted, None
    if there are none.
    """

    blocks: DataFrame
    units: DataFrame
    gone: DataFrame | None
    gone_terms: DataFrame | None
    n: int
    avgdl: float
    stem: bool
    key: str
    attributes: list[str]


def _small(df: DataFrame, rows: int = SIDE_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of the index that are whole, oldest first."""
    return manifests.versions(spark, path)


def _write(spark: SparkSession, path: str, name: str, posted: DataFrame, units: DataFrame, key: str, attributes: list[str]) -> tuple[int, int]:
    """Write postings (term, key, tf) of units (key, dl, attributes) as a segment; returns its units and their length."""
    at = f"{path}/segments/{name}"
    order = [*attributes, key]
    placed = units.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("slab", F.expr(f"monotonically_increasing_id() div {SLAB}"))
    placed.write.parquet(f"{at}/units")
    placed = spark.read.schema(placed.schema).parquet(f"{at}/units")
    n, dl = placed.agg(F.count("*"), F.sum("dl")).first()
    own = posted.join(_small(placed.select(key, "slab", "dl")), key)
    posts = F.array_sort(F.collect_list(F.struct(key, "tf", "dl"))).alias("posts")
    blocks = own.repartitionByRange("slab", "term").groupBy("term", "slab").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), posts)
    blocks.sortWithinPartitions("term", "slab").write.parquet(f"{at}/blocks")
    return n, dl or 0


def add(units: DataFrame, path: str, key: str = "chunk_id", attributes: tuple[str, ...] = ("ticker", "form", "filed"), stem: bool = True) -> int:
    """Add units (key, text, attributes) as a new segment, and return the version of the index.

    Keys that the index holds replace what it holds; a key that repeats in units is one unit with the terms of all
    its rows. Units without terms count. The key and attributes of a first call hold for all later ones.
    """
    spark = units.sparkSession
    rows = manifests.entries(spark, path, ENTRY)
    _same(rows, key, list(attributes), stem)
    name = uuid.uuid4().hex
    scratch = f"{path}/segments/{name}/scratch"
    postings(units, key, stem).write.parquet(scratch)
    posted = spark.read.parquet(scratch)
    lengths = posted.groupBy(key).agg(F.sum("tf").alias("dl"))
    each = units.groupBy(key).agg(*(F.min(a).alias(a) for a in attributes))
    each = each.join(lengths, key, "left").select(key, *attributes, F.coalesce("dl", F.lit(0)).alias("dl"))
    n, dl = _write(spark, path, name, posted, each, key, list(attributes))
    remove(spark, scratch)
    if rows:
        rows = _deleted(spark, path, rows, spark.read.parquet(f"{path}/segments/{name}/units").select(key))
    return manifests.commit(spark, path, [*rows, ("segment", name, n, dl, stem, key, list(attributes))], ENTRY)


def _same(rows: list, key: str, attributes: list[str], stem: bool) -> None:
    if rows and (rows[0]["key"], rows[0]["attributes"], rows[0]["stem"]) != (key, attributes, stem):
        raise ValueError("an index keeps the key, the attributes and the stemming that it began with")


def _deleted(spark: SparkSession, path: str, rows: list, keys: DataFrame) -> list:
    """The manifest with the units of these keys deleted, as far as it has them."""
    held = _open(spark, path, rows)
    found = live_units(held).join(_small(keys.select(held.key).distinct()), held.key, "left_semi").select("segment", "slab", held.key, "dl")
    name = uuid.uuid4().hex
    at = f"{path}/deletes/{name}"
    found.write.parquet(f"{at}/units")
    found = spark.read.schema(found.schema).parquet(f"{at}/units")
    n, dl = found.agg(F.count("*"), F.sum("dl")).first()
    if not n:
        remove(spark, at)
        return rows
    few = _small(found.select("segment", "slab", held.key))
    posted = held.blocks.join(_small(found.select("segment", "slab").distinct()), ["segment", "slab"], "left_semi").select("segment", "slab", "term", F.explode("posts").alias("p"))
    lost = posted.select("segment", "slab", "term", F.col("p").getField(held.key).alias(held.key)).join(few, ["segment", "slab", held.key], "left_semi")
    lost.groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{at}/terms")
    first = rows[0]
    return [*rows, ("deletes", name, -n, -(dl or 0), first["stem"], first["key"], first["attributes"])]


def delete(keys: DataFrame, path: str) -> int:
    """Delete the units of these keys (a column named as the index's key); unknown ones are passed over."""
    spark = keys.sparkSession
    rows = manifests.entries(spark, path, ENTRY)
    return manifests.commit(spark, path, _deleted(spark, path, rows, keys), ENTRY) if rows else 0


def _open(spark: SparkSession, path: str, rows: list) -> Segments:
    segments, deletes = ([r["name"] for r in map(_row, rows) if r["kind"] == kind] for kind in ("segment", "deletes"))
    first = _row(rows[0])

    def read(part: str) -> DataFrame:
        out = None
        for name in segments:
            one = spark.read.parquet(f"{path}/segments/{name}/{part}").withColumn("segment", F.lit(name))
            out = one if out is None else out.unionByName(one)
        return out

    gone = spark.read.parquet(*(f"{path}/deletes/{x}/units" for x in deletes)).select("segment", "slab", first["key"]) if deletes else None
    terms = spark.read.parquet(*(f"{path}/deletes/{x}/terms" for x in deletes)) if deletes else None
    n, dl = (sum(_row(r)[c] for r in rows) for c in ("n", "dl"))
    return Segments(read("blocks"), read("units"), gone, terms, n, dl / n if n else 0.0, first["stem"], first["key"], list(first["attributes"]))


def _row(row) -> dict:
    return row.asDict() if hasattr(row, "asDict") else dict(zip(("kind", "name", "n", "dl", "stem", "key", "attributes"), row, strict=True))


def load(spark: SparkSession, path: str, version: int | None = None) -> Segments:
    """The index as its newest manifest, or that of a version, lists it."""
    rows = manifests.entries(spark, path, ENTRY, version)
    if not rows:
        raise ValueError(f"no index of this version at {path}")
    return _open(spark, path, rows)


def live_units(held: Segments) -> DataFrame:
    """segment, slab, key, dl and attributes of the units that are not deleted."""
    return held.units if held.gone is None else held.units.join(_small(held.gone), ["segment", held.key], "left_anti")


def merge(spark: SparkSession, path: str) -> int:
    """Write all segments as one without what was deleted, and return the version; former ones stay readable."""
    rows = manifests.entries(spark, path, ENTRY)
    held, name = _open(spark, path, rows), uuid.uuid4().hex
    key = held.key
    posted = held.blocks.select("segment", "term", F.explode("posts").alias("p")).select("segment", "term", F.col("p").getField(key).alias(key), "p.tf")
    if held.gone is not None:
        posted = posted.join(_small(held.gone), ["segment", key], "left_anti")
    n, dl = _write(spark, path, name, posted.select("term", key, "tf"), live_units(held).select(key, *held.attributes, "dl"), key, held.attributes)
    return manifests.commit(spark, path, [("segment", name, n, dl, held.stem, key, held.attributes)], ENTRY)


def forget(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Remove all versions but the newest `keep`, and what no version that is left names; returns what was removed."""
    return manifests.forget(spark, path, ENTRY, ("segments", "deletes"), keep)


def _weight(held: Segments, tf: Column, dl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(float(held.avgdl))))


def weighted_terms(held: Segments, asked: DataFrame) -> DataFrame:
    """qid, term, idf of asked (qid, term): frequencies are sums over segments, less those deleted.

    It has no more rows than asked, so it is marked for broadcast if asked is within BROADCAST_TERMS.
    """
    few = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    marked = F.broadcast if few else (lambda df: df)
    wanted = asked.select("term").distinct()
    df = held.blocks.select("term", "n").join(marked(wanted), "term", "left_semi").select("term", F.col("n").alias("df"))
    if held.gone_terms is not None:
        df = df.unionByName(held.gone_terms.join(marked(wanted), "term", "left_semi").select("term", (-F.col("df")).alias("df")))
    df = df.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
    raw = F.log((F.lit(held.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return marked(saved(asked.join(df, "term").select("qid", "term", F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF)).alias("idf"))))


def slab_bounds(held: Segments, weighted: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """qid, segment, slab, bound: what no unit of the slab can exceed; `only` (see `search`) restricts the slabs."""
    found = held.blocks.select("segment", "slab", "term", "max_tf", "min_dl").join(weighted, "term")
    if only is not None:
        found = found.join(_small(only.select("qid", "segment", "slab").distinct()), ["qid", "segment", "slab"], "left_semi")
    return found.groupBy("qid", "segment", "slab").agg(F.sum(F.col("idf") * _weight(held, F.col("max_tf"), F.col("min_dl"))).alias("bound"))


def _best_of_slab(avgdl: float, k: int, key: str, filtered: bool):
    def run(rows: pa.Table) -> pa.Table:
        """qid, key, score of the units that may be among a question's k best of a slab.

        Rows of kind 0 are the slab's terms with their postings and the questions that ask for them, of kind 1 the
        questions that want the slab, 2 the units that a question may find, 3 the units deleted. Scores are sums of
        products of two matrices; those within a rounding of the k-th stay, as they are rounded and ranked later.
        """
        of = lambda kind, column: rows.filter(pc.equal(rows["kind"], kind))[column].combine_chunks()
        posts, asks, wanted = of(0, "posts"), of(0, "asks"), of(1, "qid").unique()
        place = lambda lists: np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        post, ask = posts.flatten(), asks.flatten()
        units = post.field(key).unique()
        within = lambda values, names: pc.fill_null(pc.index_in(values, value_set=names), -1).to_numpy(zero_copy_only=False)
        tf, dl = (post.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("tf", "dl"))
        weight = np.zeros((len(posts), len(units)))
        weight[place(posts), within(post.field(key), units)] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
        asker, term, idf = within(ask.field("qid"), wanted), place(asks), ask.field("idf").to_numpy(zero_copy_only=False)
        may = np.zeros((len(wanted), len(units)), bool) if filtered else np.ones((len(wanted), len(units)), bool)
        if filtered:
            q, u = within(of(2, "qid"), wanted), within(of(2, key), units)
            both = (q >= 0) & (u >= 0)
            may[q[both], u[both]] = True
        gone = within(of(3, key), units)
        may[:, gone[gone >= 0]] = False
        found: list[tuple] = []
        for at in range(0, len(wanted) if len(units) else 0, QUESTION_BLOCK):
            own = (asker >= at) & (asker < at + QUESTION_BLOCK)
            idfs = np.zeros((min(QUESTION_BLOCK, len(wanted) - at), len(posts)))
            np.add.at(idfs, (asker[own] - at, term[own]), idf[own])
            scores = idfs @ weight
            scores[~(may[at : at + QUESTION_BLOCK] & (scores > 0))] = -np.inf
            least = np.partition(scores, max(0, len(units) - k), axis=1)[:, max(0, len(units) - k)] - 2 * 10.0**-PLACES
            q, u = np.nonzero((scores >= least[:, None]) & (scores > 0))
            found.append((q + at, u, scores[q, u]))
        q, u, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))
        return pa.table({"qid": wanted.take(pa.array(q)), key: units.take(pa.array(u)), "score": score})

    return run


def _scored(held: Segments, weighted: DataFrame, slabs: DataFrame, only: DataFrame | None, k: int) -> DataFrame:
    """qid, key, score of the units that may be among the k best of the given slabs (qid, segment, slab) of each question.

    Postings move once, whatever the number of questions, and so do the keys of `only`: neither side is ever laid
    out as a row for each question and posting.
    """
    key, at = held.key, ["segment", "slab"]
    asks = weighted.groupBy("term").agg(F.collect_list(F.struct("qid", "idf")).alias("asks"))
    few = _small(slabs.select(*at).distinct())
    rows = held.blocks.select(*at, "term", "posts").join(_small(asks, BROADCAST_TERMS), "term").join(few, at, "left_semi").select(*at, F.lit(0).alias("kind"), "asks", "posts")
    for kind, more in ((1, slabs.select(*at, "qid")), (2, None if only is None else only.select(*at, "qid", key)), (3, None if held.gone is None else held.gone.select(*at, key))):
        if more is not None:
            more = more if kind == 1 else more.join(few, at, "left_semi")
            rows = rows.unionByName(more.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields} | {key: held.units.schema[key].dataType.simpleString()}
    rows = rows if key in rows.columns else rows.withColumn(key, F.lit(None).cast(kinds[key]))
    best = rows.groupBy(*at).applyInArrow(_best_of_slab(float(held.avgdl) or 1.0, k, key, only is not None), f"qid {kinds['qid']}, `{key}` {kinds[key]}, score double")
    return best.withColumn("score", F.round("score", PLACES))


def _ranked(scored: DataFrame, k: int, key: str) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), key))).filter(F.col("rank") <= k)


def wanted_slabs(held: Segments, weighted: DataFrame, k: int, only: DataFrame | None = None) -> DataFrame:
    """qid, segment, slab of the slabs that may hold one of the k best units of a question.

    Each question's first slabs by bound (FIRST, k at least) are scored; of the others those stay whose bound
    reaches the k-th best score found. Where fewer than k units are found all slabs stay.
    """
    bounds = saved(slab_bounds(held, weighted, only))
    nth = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("bound"), "segment", "slab"))
    first = bounds.withColumn("nth", nth).filter(F.col("nth") <= max(FIRST, k)).select("qid", "segment", "slab")
    need = _ranked(_scored(held, weighted, first, only, k), k, held.key).filter(F.col("rank") == k).select("qid", F.col("score").alias("need"))
    # one number a question: read once, where the questions are few, so that this pass is not run again below
    rows = need.limit(SIDE_ROWS // 10 + 1).collect()
    if len(rows) <= SIDE_ROWS // 10:
        need = F.broadcast(need.sparkSession.createDataFrame(rows, need.schema))
    # the sums of bounds and of scores round differently
    return bounds.join(need, "qid", "left").filter("need IS NULL OR bound + 1e-5 >= need").select("qid", "segment", "slab")


def search(held: Segments, asked: DataFrame, k: int = 10, only: DataFrame | None = None) -> DataFrame:
    """qid, key, score, rank: the k best units of each question by BM25, ties to the smaller key.

    asked: qid, term. only (qid, segment, slab, key): what `allowed` gives; a question without a row there gets
    nothing. Postings are read of the slabs that `wanted_slabs` leaves.
    """
    weighted = weighted_terms(held, asked)
    slabs = saved(wanted_slabs(held, weighted, k, only))
    return _ranked(_scored(held, weighted, slabs, only, k), k, held.key).select("qid", held.key, "score", "rank")


def allowed(held: Segments, questions: DataFrame, *conditions: Column, on: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """qid, segment, slab, key of the units that a question may find: equal in `on`, and with all conditions true.

    Decided on the units alone, before any posting is read.
    """
    out = live_units(held).join(_small(questions), list(on))
    for c in conditions:
        out = out.filter(c)
    return out.select("qid", "segment", "slab", held.key)


def search_relaxed(held: Segments, asked: DataFrame, only: DataFrame, k: int = 10) -> DataFrame:
    """As `search` with only, but questions that this leaves without a unit search all; relaxed says which.

    A question has a unit left if one that it may find shares a term with it, which the slabs' bounds need not
    say; so it is asked of the filtered results.
    """
    filtered = search(held, asked, k, only)
    none = asked.join(filtered.select("qid").distinct(), "qid", "left_anti")
    out = filtered.withColumn("relaxed", F.lit(False))
    return out if none.isEmpty() else out.unionByName(search(held, none, k).withColumn("relaxed", F.lit(True)))
