"""Candidates for questions: BM25, cosine, the merge of both, relaxation, full text, lexical ranking, passages.

Everything is over a table of questions; one question is the case of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.functions.questions import search_terms
from quillstone.functions.text import blank_if_null, citation, passage_text, terms, without_stopwords

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Question terms and question blocks within these sizes are broadcast; larger ones are left to a shuffle.
BROADCAST_TERMS, QUESTION_BLOCK = 500_000, 256
#: Scores are compared after rounding, so that the order of a sum decides no tie.
PLACES = 6


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def top_ranked(scored: DataFrame, k: int, key: str) -> DataFrame:
    """The k best of each question (qid) by score, ties by key, with their rank."""
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def question_terms(questions: DataFrame) -> DataFrame:
    """qid, term: the distinct search terms of each question."""
    return questions.select("qid", F.explode(search_terms(F.col("question"))).alias("term"))


def bm25_scores(asked: DataFrame, posted: DataFrame, lengths: DataFrame, corpus: DataFrame, key: str = "chunk_id") -> DataFrame:
    """qid, key, score of every unit that shares a term (qid, term) with a question.

    Statistics are the whole corpus's. An idf that is not positive becomes LEAST_IDF.
    """
    wanted = _small(asked, BROADCAST_TERMS)
    frequencies = posted.join(_small(asked.select("term").distinct(), BROADCAST_TERMS), "term", "left_semi")
    df = frequencies.groupBy("term").agg(F.count("*").alias("df"))
    hits = frequencies.join(df, "term").join(wanted, "term").join(lengths, key).crossJoin(F.broadcast(corpus))
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("qid", key).agg(F.round(F.sum(part), PLACES).alias("score"))


def bm25(asked: DataFrame, posted: DataFrame, lengths: DataFrame, corpus: DataFrame, k: int = 10, key: str = "chunk_id", only: DataFrame | None = None) -> DataFrame:
    """qid, key, score, rank: the k best units; `only` (qid, key) restricts the candidates and changes no score."""
    scored = bm25_scores(asked, posted, lengths, corpus, key)
    if only is not None:
        scored = scored.join(only, ["qid", key], "left_semi")
    return top_ranked(scored, k, key).select("qid", key, "score", "rank")


def bm25_relaxed(asked: DataFrame, posted: DataFrame, lengths: DataFrame, corpus: DataFrame, only: DataFrame, k: int = 10, key: str = "chunk_id") -> DataFrame:
    """As `bm25` with `only`, but questions of which no candidate is left are ranked over all units (relaxed)."""
    filtered = bm25(asked, posted, lengths, corpus, k, key, only)
    rest = asked.join(filtered.select("qid").distinct(), "qid", "left_anti")
    return relaxed(filtered, bm25(rest, posted, lengths, corpus, k, key))


def cosine(queries: DataFrame, vectors: DataFrame, k: int = 10, key: str = "chunk_id", keep: Column | None = None) -> DataFrame:
    """qid, key, score, rank: the k nearest vectors (key, v) to each query (qid, v) by cosine.

    Queries travel in blocks; every vector meets every block, and filters are applied before the cut. Vectors
    of length 0 and queries of length 0 have no cosine and take no part.
    """
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    q = queries.select("qid", "v", norm(F.col("v")).alias("qn")).filter("qn > 0")
    n = q.count()
    blocks = max(1, -(-n // QUESTION_BLOCK))
    packed = q.groupBy(F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("qid", "v", "qn")).alias("qs"))
    side = F.broadcast(packed) if blocks <= 16 else packed
    c = vectors.select(key, "v", norm(F.col("v")).alias("n"), *(["keep"] if keep is not None else [])).filter("n > 0")
    c = c.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).join(side, "block")
    each = c.select(key, F.col("v").alias("cv"), "n", F.explode("qs").alias("q"))
    dot = F.aggregate(F.zip_with("cv", "q.v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return top_ranked(each.select(F.col("q.qid").alias("qid"), key, F.round(dot / (F.col("n") * F.col("q.qn")), PLACES).alias("score")), k, key).select("qid", key, "score", "rank")


def interleaved(first: DataFrame, second: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rank by rank, first list before second; an entry of both counts where it comes first. pos counts from 1."""
    both = first.select("qid", key, (2 * F.col("rank") - 1).alias("at")).unionByName(second.select("qid", key, (2 * F.col("rank")).alias("at")))
    once = both.groupBy("qid", key).agg(F.min("at").alias("at"))
    return once.select("qid", key, F.row_number().over(W.partitionBy("qid").orderBy("at")).alias("pos"))


def relaxed(filtered: DataFrame, unfiltered: DataFrame) -> DataFrame:
    """The filtered results, and the unfiltered ones of the questions that have none; relaxed says which."""
    rest = unfiltered.join(filtered.select("qid").distinct(), "qid", "left_anti")
    return filtered.withColumn("relaxed", F.lit(False)).unionByName(rest.withColumn("relaxed", F.lit(True)))


def with_full_text(hits: DataFrame, units: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Join the whole text after the cut; a hit that the units lack keeps its own text, if it has one.

    The ids asked for go to the units where they are few, so that only the texts of hits are moved.
    """
    units = units.join(_small(hits.select(key).distinct(), BROADCAST_TERMS), key, "left_semi")
    full = units.select(key, F.col("text").alias("_full"), *(c for c in ("ticker", "form", "filed", "page") if c in units.columns and c not in hits.columns))
    own = F.col("text") if "text" in hits.columns else F.lit(None).cast("string")
    return hits.join(full, key, "left").withColumn("text", F.coalesce("_full", own)).drop("_full")


def without_interim(hits: DataFrame, wants_annual: Column) -> DataFrame:
    """Where an annual report is wanted and found, drop the quarterly ones."""
    found = F.max(F.col("form") == "10-K").over(W.partitionBy("qid"))
    return hits.withColumn("_annual", found).filter(~F.coalesce(wants_annual & F.col("_annual") & (F.col("form") == "10-Q"), F.lit(False))).drop("_annual")


def rank_terms(text: Column) -> Column:
    return F.array_distinct(without_stopwords(terms(text, r"[a-z0-9$%.]+")))


def lexical_rank(hits: DataFrame, questions: DataFrame, k: int = 5, key: str = "chunk_id") -> DataFrame:
    """Order each question's candidates by rare shared terms, for their length.

    A term's weight is ln((n + 1) / (df + 1)) + 1 over the n candidates. The share of the question's weight
    that a candidate has is divided by 0.25 + 0.75 of its distinct terms over their mean. Ties keep the
    candidates' order (pos).
    """
    asked = questions.select("qid", rank_terms(F.col("question")).alias("_asked"))
    c = hits.withColumn("_terms", rank_terms(F.col("text"))).join(asked, "qid")
    per = W.partitionBy("qid")
    c = c.withColumn("_n", F.count("*").over(per)).withColumn("_mean", F.avg(F.size("_terms")).over(per))
    c = c.withColumn("_most", F.log(F.col("_n") + 1) + 1.0)
    each = c.select("*", F.explode_outer(F.array_intersect("_asked", "_terms")).alias("_term"))
    df = F.count("_term").over(W.partitionBy("qid", "_term"))
    each = each.withColumn("_df", F.when(F.col("_term").isNotNull(), df)).withColumn("_weight", F.log((F.col("_n") + 1) / (F.col("_df") + 1)) + 1.0)
    # a term that no candidate has weighs most; of the others each holder counts its part
    total = F.size("_asked") * F.col("_most") - F.coalesce(F.sum((F.col("_most") - F.col("_weight")) / F.col("_df")).over(per), F.lit(0.0))
    each = each.withColumn("_total", total)
    kept = [x for x in hits.columns if x not in ("qid", key)]
    c = each.groupBy("qid", key).agg(F.sum("_weight").alias("_hit"), *(F.first(x).alias(x) for x in [*kept, "_total", "_mean", "_terms"]))
    total = F.col("_total")
    norm = 1 - B + B * F.size("_terms") / F.col("_mean")
    score = F.when(total > 0, F.coalesce("_hit", F.lit(0.0)) / total).otherwise(0.0)
    c = c.withColumn("score", F.round(F.when((F.col("_mean") > 0) & (norm > 0), score / norm).otherwise(score), PLACES))
    rank = F.row_number().over(per.orderBy(F.desc("score"), "pos"))
    return c.withColumn("rank", rank).filter(F.col("rank") <= k).drop("_terms", "_mean", "_hit", "_total")


def passages(ranked: DataFrame, key: str = "chunk_id") -> DataFrame:
    """What a caller gets: id, company, form, date, page, citation and the text, cut at its bound."""
    page = F.col("page") if "page" in ranked.columns else F.lit(None).cast("int")
    return ranked.select(
        "qid", "rank", F.col(key).alias("id"), "ticker", "form", "filed", page.alias("page"),
        citation(F.col("ticker"), F.col("form"), F.col("filed"), page).alias("citation"), passage_text(blank_if_null(F.col("text"))).alias("text"),
    )


def item_winners(base: DataFrame, winners: DataFrame, cap: int = 8, key: str = "chunk_id") -> DataFrame:
    """Append, line by line, the best unit of each line that is not there yet, up to cap in all.

    base: qid, key, pos. winners: qid, line, rank, key. A fold, as each choice depends on those before.
    """
    have = base.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("pos", F.col(key).alias("key")))).alias("b"))
    lines = winners.groupBy("qid", "line").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col(key).alias("key")))), lambda x: x["key"]).alias("keys"))
    lines = lines.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "keys"))), lambda x: x["keys"]).alias("w"))
    start = F.transform("b", lambda x: x["key"])

    def step(acc: Column, keys: Column) -> Column:
        fresh = F.filter(keys, lambda x: ~F.array_contains(acc, x))
        return F.when((F.size(acc) < cap) & (F.size(fresh) > 0), F.concat(acc, F.slice(fresh, 1, 1))).otherwise(acc)

    out = have.join(lines, "qid", "left").withColumn("all", F.aggregate(F.coalesce("w", F.array().cast("array<array<string>>")), start, step))
    return out.select("qid", F.posexplode("all").alias("at", key)).select("qid", key, (F.col("at") + 1).alias("pos"))


def rerank_tokens(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """The tokens that ranking each question's candidates costs."""
    asked = questions.select("qid", F.length("question").alias("q"))
    sums = hits.groupBy("qid").agg(F.sum(F.least(F.length("text"), F.lit(8000))).alias("s"), F.count("*").alias("n"))
    return sums.join(asked, "qid").select("qid", (F.floor((F.col("s") + F.col("q") * F.col("n")) / 4) + 1).alias("tokens"))
