"""The public questions, as functions of tables that return tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.functions import questions as Q
from quillstone.functions.reference import FORM, TICKER
from quillstone.operators import chunks, facts, index, neighbours, pages, retrieve, segments, service, verify
from quillstone.session import saved

KEYWORD_ONLY = "Dense search is not available; results are by keyword only."
NO_MATCH = "No passage matches; try the wording of the filings, or another year."
OVER_BUDGET = "Ranked by shared words: the day's budget for ranking is used up, so passages may fit less well."
OTHER_YEARS = "No filing matches %s; these passages are from other years."
CANDIDATES = 40


def check_text(value: str, most: int, name: str) -> str:
    if not value or not value.strip() or len(value) > most:
        raise ValueError(f"{name} must have 1 to {most} characters")
    return value.strip()


def check_list(values: list, least: int, most: int, name: str) -> list:
    out = list(dict.fromkeys(values))
    if not least <= len(out) <= most:
        raise ValueError(f"{name} must have {least} to {most} different entries")
    return out


def check_ticker(value: str) -> str:
    if not re.fullmatch(TICKER, value.strip()):
        raise ValueError(f"{value!r} is not a ticker")
    return value.strip().upper()


def check_form(value: str) -> str:
    if not re.fullmatch(FORM, value):
        raise ValueError(f"{value!r} is not a form")
    return value


def check_year(year: int | None) -> int | None:
    if year is not None and not 1993 <= year <= 2100:
        raise ValueError("years run from 1993 to 2100")
    return year


def require_covered(cover: DataFrame, ticker: str) -> str:
    if cover.filter(F.col("ticker") == ticker).isEmpty():
        raise ValueError(f"{ticker} is not covered; {cover.select('ticker').distinct().count()} companies are")
    return ticker


def search_filings(
    units: DataFrame, question: str, ticker: str | None = None, year: int | None = None, vectors: DataFrame | neighbours.Placed | None = None, query_vector: list[float] | None = None,
    k: int = CANDIDATES, top: int = 5, key: str = "chunk_id", loaded: index.Index | segments.Segments | None = None, cover: DataFrame | None = None, embed: Callable | None = None, rank: Callable | None = None, budget: int | None = None, stage: str = "reranked",
) -> DataFrame:
    """The best passages for a question over units (key, ticker, form, filed, text), with a note on how they were found.

    Company and years come from the arguments, else from the question. If the filters leave nothing, keyword and
    dense search are done without them; passages of another company than an explicit one are never given. Without
    vectors the search is by keyword; vectors that `neighbours.place` has placed are searched by pivots. loaded: an index from `segments.load` or `index.load`; without it
    one is made of the units.
    embed: question -> vector. rank: (hits, questions, top, key) -> ranked hits, in place of shared words; it is used
    while its cost in tokens is within the budget. cover: rows of coverage that an explicit company must be among.
    stage: "candidates" gives all that was retrieved, before ranking.
    """
    spark = units.sparkSession
    if stage not in ("candidates", "reranked"):
        raise ValueError(f"{stage!r} is no stage")
    check_text(question, 500, "question")
    if ticker and cover is not None:
        require_covered(cover, check_ticker(ticker))
    asked = spark.createDataFrame([(0, question)], "qid int, question string").withColumn("question", Q.cleaned(F.col("question")))
    row = asked.select("question", Q.company(F.col("question")).alias("t"), Q.years(F.col("question")).alias("y")).first()
    named = [check_year(year)] if year is not None else row["y"]
    symbol = check_ticker(ticker) if ticker else row["t"]
    window = (f"{min(named)}-01-01", f"{max(named) + 1}-12-31") if named else None
    found = loaded or index.made(units, key)
    grown = isinstance(found, segments.Segments)
    terms = retrieve.question_terms(asked.withColumn("question", Q.expanded(F.col("question"))))
    terms = index.stemmed_terms(terms) if found.stem else terms
    if vectors is not None and query_vector is None and embed is not None:
        query_vector = embed(row["question"])
    dense = vectors is not None and query_vector is not None

    def candidates(only: DataFrame | None) -> list:
        """At most 2 k rows (qid, key, pos): with them here, what follows reads the index no more."""
        if grown:
            own = segments.live_units(found)
            own = own if only is None or not symbol else own.filter(F.col("ticker") == symbol)
            own = own if only is None or not window else own.filter(F.col("filed").between(*window))
            hits = segments.search(found, terms, k, None if only is None else own.select(F.lit(0).alias("qid"), "segment", "slab", key))
        else:
            hits = retrieve.bm25(terms, found.postings, found.lengths, found.corpus, k, key, only)
        near = hits.limit(0)
        if dense:
            placed = isinstance(vectors, neighbours.Placed)
            v = vectors.units if placed else vectors
            v = v if only is None else v.join(only.select(key), key, "left_semi")
            asked_for = spark.createDataFrame([(0, query_vector)], "qid int, v array<double>")
            near = neighbours.nearest(asked_for, vectors._replace(units=v), k, key) if placed else retrieve.cosine(asked_for, v, k, key)
        return retrieve.interleaved(hits, near, key).collect()

    only = None
    if symbol or window:
        only = units.select(F.lit(0).alias("qid"), key, "ticker", "filed")
        only = only.filter(F.col("ticker") == symbol) if symbol else only
        only = (only.filter(F.col("filed").between(*window)) if window else only).select("qid", key)
    merged = candidates(only) or (candidates(None) if only is not None else [])
    merged = spark.createDataFrame(merged, units.select(F.lit(0).alias("qid"), key, F.lit(0).alias("pos")).schema)
    full = retrieve.with_full_text(merged, units, key).withColumn("text", pages.repaired(F.coalesce("text", F.lit(""))))
    if ticker:
        full = full.filter(F.upper("ticker") == symbol)
    annual = Q.wants_annual(F.lit(question), F.array(*map(F.lit, named)) if named else F.array().cast("array<int>"))
    full = retrieve.without_interim(full, annual)
    notes = [] if dense else [KEYWORD_ONLY]
    if stage == "candidates":
        ranked = full.withColumn("rank", F.col("pos"))
    elif rank is not None:
        cost = retrieve.rerank_tokens(full, asked).first() if budget is not None else None
        within = cost is None or cost["tokens"] <= budget
        ranked = (rank if within else retrieve.lexical_rank)(full, asked, top, key)
        notes += [] if within else [OVER_BUDGET]
    else:
        ranked = retrieve.lexical_rank(full, asked, top, key)
    out = retrieve.passages(ranked, key)
    # whether any passage is from the years that the caller named, over the few passages themselves
    aside = F.lit(None).cast("string")
    if year is not None and stage == "reranked":
        fits = F.max(F.col("filed").between(*window)).over(W.partitionBy("qid"))
        aside = F.when(~F.coalesce(fits, F.lit(False)), F.lit(OTHER_YEARS % year))
    note = F.concat_ws(" ", *map(F.lit, notes), aside)
    return out.withColumn("note", F.when(note != "", note))


def health(units: DataFrame, question: str, **options) -> DataFrame:
    """One row that says whether a search works: ok, passages, note, error.

    A real retrieval, but for the ranking. It fails if it finds nothing, if it had to do without what it was given
    (its note says so), or if it breaks off, which is a row too and no exception.
    """
    n, note, error = 0, None, None
    try:
        found = search_filings(units, question, stage="candidates", **options).select("id", "note").collect()
        n, note = len(found), found[0]["note"] if found else None
    except Exception as e:  # whatever the reason, the verdict is a row
        error = f"{type(e).__name__}: {e}"[:500]
    told = note if options.get("vectors") is not None or note != KEYWORD_ONLY else None
    return units.sparkSession.createDataFrame([(question, n > 0 and not told, n, note, error)], "question string, ok boolean, passages int, note string, error string")


def search_result(passages: DataFrame) -> DataFrame:
    """One row for a search: its passages in order, and its note; a search without passages says so."""
    order = F.sort_array(F.collect_list(F.struct("rank", "id", "ticker", "form", "filed", "page", "citation", "text")))
    got = passages.agg(order.alias("passages"), F.first("note").alias("note"))
    return got.withColumn("note", F.when(F.size("passages") == 0, F.lit(NO_MATCH)).otherwise(F.col("note")))


def company_financials(all_facts: DataFrame, ciks: dict[str, int], tickers: list[str], metrics: list[str], period: str = "latest", strict: bool = False) -> DataFrame:
    """Exact figures of companies: one row for each ticker and metric, errors as rows; see `facts.answers`."""
    spark = all_facts.sparkSession
    tickers = [check_ticker(t) for t in check_list(tickers, 1, 5, "tickers")]
    metrics = [check_text(m, 100, "metric") for m in check_list(metrics, 1, 10, "metrics")]
    period = check_text(period or "latest", 40, "period")
    rows = [(f"{t}/{m}", t, ciks.get(t), m, period) for t in tickers for m in metrics]
    asked = spark.createDataFrame(rows, "rid string, ticker string, cik long, metric string, period string").withColumn("p", Q.period(F.col("period")))
    if not asked.filter("NOT p.ok").isEmpty():
        raise ValueError(f"the period {period!r} is not understood")
    asked = facts.resolved(asked.select("rid", "ticker", "cik", "metric", "p.fy", "p.fp"), strict)
    wanted = F.broadcast(asked.select("cik").distinct())  # five companies at most
    found = saved(facts.values(all_facts.join(wanted, "cik", "left_semi")))  # some ten thousand rows, read by every part of the answer
    return facts.answers(asked, found, facts.metric_table(spark))


def compare_companies(all_facts: DataFrame, ciks: dict[str, int], tickers: list[str], metrics: list[str], period: str = "latest", strict: bool = False) -> DataFrame:
    """The same figures of two to five companies, in the order asked for; a company that is not known is an error of its own."""
    if len(tickers) > 10:
        raise ValueError("compare two to five companies")
    tickers = check_list([check_ticker(t) for t in tickers], 2, 5, "tickers")
    out = company_financials(all_facts, ciks, tickers, metrics, period, strict)
    place = F.array_position(F.array(*map(F.lit, tickers)), F.col("ticker"))
    asked = F.array(*(F.lit(m) for m in dict.fromkeys(metrics)))
    unknown = F.when(F.col("cik").isNull(), F.format_string("%s is not a company with a number", "ticker"))
    out = out.withColumn("error", F.coalesce(unknown, "error"))
    return out.select(place.cast("int").alias("company"), F.array_position(asked, F.substring_index("rid", "/", -1)).cast("int").alias("line"), *out.columns).orderBy("company", "line")


def latest_filing(listed: DataFrame, cover: DataFrame, ticker: str, form: str) -> DataFrame:
    return service.latest_filing(listed.filter((F.col("ticker") == check_ticker(ticker)) & (F.col("form") == check_form(form))), cover)


def covered_companies(cover: DataFrame) -> DataFrame:
    return chunks.nested_companies(cover)


def verify_figures(answer: str, ids: list[str], passages: DataFrame, found: DataFrame, ciks: dict[str, int]) -> DataFrame:
    """Check an answer's figures against cited passages (key, text) and cited facts (ids of exact figures, derived ones too)."""
    spark = passages.sparkSession
    check_text(answer, 20_000, "answer")
    ids = check_list(ids, 1, 20, "ids")
    drafts = spark.createDataFrame([(0, answer, ids)], "id int, answer string, ids array<string>")
    companies = F.broadcast(spark.createDataFrame(list(ciks.items()), "ticker string, cik long"))  # the caller's own table
    exact = facts.values_of(drafts.select(F.explode("ids").alias("key")).distinct(), found, companies, facts.metric_table(spark))
    return verify.combined(drafts, passages.filter(F.col("key").isin(ids)), exact)
