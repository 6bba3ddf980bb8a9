"""Queries over filings as text: coverage, blocks, chunks, postings, candidates, passages."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import questions as Q
from quillstone.functions.reference import COMPANY_NAMES, RATIO_LINES, STOPWORDS, SYNONYMS
from quillstone.functions.stem import stemmed
from quillstone.operators import chunks, index, neighbours, pages, retrieve, segments, service
from quillstone.session import files_of, saved, shared_folder
from quillstone.sources.filings import filings, first_per_form, table

K = 10


def _units(spark: SparkSession, d: str) -> DataFrame:
    """Whole filings as the units of retrieval."""
    return filings(spark, d)


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """benchmark items as questions, each with a company, a window of filing dates and a wish for annual reports."""
    b = table(spark, d, "benchmark")
    return b.select(
        F.col("item_id").alias("qid"), F.col("text").alias("question"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("ticker"),
        F.lit("2015-01-01").alias("filed_from"), F.concat((2015 + F.col("item_id") % 4).cast("string"), F.lit("-12-31")).alias("filed_to"), (F.col("item_id") % 2 == 0).alias("annual"),
    )


def _index(spark: SparkSession, d: str) -> segments.Segments:
    """The index of the filings as the shared folder holds it; written there once for each state of the table's files."""
    files, path = files_of(spark, f"{d}/documents.parquet")
    held = files.getContentSummary(path)
    state = f"{path}|{held.getLength()}|{held.getFileCount()}|{files.getFileStatus(path).getModificationTime()}"
    at = f"{shared_folder(spark)}/indexes/{hashlib.sha256(state.encode()).hexdigest()[:16]}"
    if not segments.versions(spark, at):
        segments.add(_units(spark, d), at, "doc_id", stem=False)
    return segments.load(spark, at)


def _own_filings(held: segments.Segments, asked: DataFrame) -> DataFrame:
    """The filings of each question's company and window."""
    return segments.allowed(held, asked.select("qid", "ticker", "filed_from", "filed_to"), F.col("filed").between(F.col("filed_from"), F.col("filed_to")))


def _keyword(held: segments.Segments, asked: DataFrame, mode: str) -> DataFrame:
    """BM25 over all units (all), those of the question's company and window (filtered), or those if any (relaxed)."""
    terms = retrieve.question_terms(asked)
    if mode == "all":
        return segments.search(held, terms, K)
    only = _own_filings(held, asked)
    return segments.search(held, terms, K, only) if mode == "filtered" else segments.search_relaxed(held, terms, only, K)


def _dense(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    q = _questions(spark, d).select("qid").join(v.select(F.col("doc_id").alias("qid"), "v"), "qid")
    return retrieve.cosine(q, v, K, "doc_id")


def q66_near_in_groups(spark, d):
    """The nearest vectors of even labels, by pivots; the filter comes before the search and its bounds."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    q = _questions(spark, d).select("qid").join(v.select(F.col("doc_id").alias("qid"), "v"), "qid")
    placed = neighbours.place(v, "doc_id")
    placed = placed._replace(units=saved(placed.units))
    even = table(spark, d, "embeddings").filter("label % 2 = 0").select(F.col("vec_id").alias("doc_id"))
    return neighbours.nearest(q, placed._replace(units=placed.units.join(even, "doc_id", "left_semi")), K, "doc_id")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """One table of ids a question; saved, as text is joined to it and it is ranked after that."""
    return saved(retrieve.interleaved(_keyword(_index(spark, d), _questions(spark, d), "relaxed"), _dense(spark, d), "doc_id"))


def q01_coverage(spark, d):
    return chunks.coverage(chunks.text_blocks(filings(spark, d)))


def q02_covered_companies(spark, d):
    return chunks.covered_companies(q01_coverage(spark, d))


def q03_corpus_totals(spark, d):
    return chunks.corpus_totals(chunks.text_blocks(filings(spark, d)))


def q04_text_blocks(spark, d):
    return chunks.text_blocks(filings(spark, d)).select("doc_id", "pos", F.length("block").alias("n_chars"), F.md5("block").alias("digest"))


def q05_chunk_ids(spark, d):
    from quillstone.functions.text import chunk_id

    b = chunks.text_blocks(filings(spark, d))
    return b.select("doc_id", "pos", chunk_id(F.col("ticker"), F.col("form"), F.col("filed"), F.lit("child"), F.lit("body"), F.col("block")).alias("chunk_id"))


def q06_child_chunks(spark, d):
    return chunks.chunks(filings(spark, d), "child").select("chunk_id", "doc_id", "nth", "words")


def q07_parent_chunks(spark, d):
    return chunks.chunks(filings(spark, d), "parent").select("chunk_id", "doc_id", "nth", "words")


def q08_postings(spark, d):
    return index.postings(_units(spark, d), "doc_id")


def q09_bm25_topk(spark, d):
    return _keyword(_index(spark, d), _questions(spark, d), "all")


def q10_bm25_filtered(spark, d):
    return _keyword(_index(spark, d), _questions(spark, d), "filtered")


def _grown(spark: SparkSession, d: str) -> str:
    """An index that grew: the even filings first, then the odd ones and every tenth again, less every seventh of them all."""
    at, f = f"{shared_folder(spark)}/indexes/grown-{uuid.uuid4().hex}", _units(spark, d)
    segments.add(f.filter("doc_id % 2 = 0"), at, "doc_id", stem=False)
    segments.add(f.filter("doc_id % 2 = 1 OR doc_id % 10 = 0"), at, "doc_id", stem=False)
    segments.delete(f.filter("doc_id % 7 = 3").select("doc_id"), at)
    return at


def q62_grown_index(spark, d):
    """BM25 over an index of two segments and deletions."""
    return _keyword(segments.load(spark, _grown(spark, d)), _questions(spark, d), "all")


def q63_merged_index(spark, d):
    """The same, filtered, once the segments are one."""
    at = _grown(spark, d)
    segments.merge(spark, at)
    return _keyword(segments.load(spark, at), _questions(spark, d), "relaxed")


def q11_dense_topk(spark, d):
    return _dense(spark, d)


def q12_hybrid_merge(spark, d):
    return retrieve.interleaved(_keyword(_index(spark, d), _questions(spark, d), "all"), _dense(spark, d), "doc_id")


def q13_filter_relaxation(spark, d):
    return _keyword(_index(spark, d), _questions(spark, d), "relaxed")


def q14_hydrate(spark, d):
    full = retrieve.with_full_text(_candidates(spark, d), _units(spark, d), "doc_id")
    return full.select("qid", "pos", "doc_id", "ticker", "form", "filed", F.md5("text").alias("digest"))


def _ranked(spark, d):
    asked = _questions(spark, d)
    full = retrieve.with_full_text(_candidates(spark, d), _units(spark, d), "doc_id").withColumn("text", pages.repaired(F.coalesce("text", F.lit(""))))
    full = retrieve.without_interim(full.join(asked.select("qid", "annual"), "qid"), F.col("annual"))
    return retrieve.lexical_rank(full, asked, 5, "doc_id")


def q15_lexical_rerank(spark, d):
    return _ranked(spark, d).select("qid", "rank", "doc_id", "score")


def q16_find_passages(spark, d):
    out = retrieve.passages(_ranked(spark, d).filter("ticker IS NOT NULL"), "doc_id")
    return out.select("qid", "rank", "id", "citation", F.md5("text").alias("digest"), F.length("text").alias("n_chars"))


def q29_html_blocks(spark, d):
    return pages.page_blocks(table(spark, d, "pages")).select("page_id", "pos", F.length("block").alias("n_chars"), F.md5("block").alias("digest"))


def q64_typed_tables(spark, d):
    """The tables of pages that list each customer's orders: numbers with commas, blanks, marks of absence, truth values."""
    k = F.col("o_orderkey")
    price = F.format_number("o_totalprice", 2)
    cells = (k, price, F.when(k % 4 == 0, F.when(k % 8 == 0, "n/a").otherwise("")).otherwise((k % 1000).cast("string")), F.when(k % 2 == 0, "TRUE").otherwise("false"), F.when(k % 3 == 0, "NULL").when(k % 3 == 1, price).otherwise("as agreed"))
    row = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), c.cast("string"), F.lit("</td>")) for c in cells), F.lit("</tr>"))
    listed = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, row.alias("row")))), lambda x: x["row"]), "").alias("rows"))
    html = F.concat(F.lit("<p>Orders</p><table><tr><th>order</th><th>price</th><th>rank</th><th>open</th><th></th></tr>"), "rows", F.lit("</table>"))
    found = pages.page_tables(listed.select("page_id", html.alias("html")))
    return found.select(F.col("page_id").alias("o_custkey"), F.array_join("headers", "|").alias("headers"), F.posexplode("rows").alias("place", "cells")).select("o_custkey", "headers", "place", F.array_join("cells", "|").alias("cells"))


def q29b_stem(spark, d):
    """The stemmed dictionary of the corpus: for each stem its forms and occurrences."""
    words = index.postings(_units(spark, d), "doc_id").groupBy("term").agg(F.sum("tf").alias("n"))
    return words.withColumn("stem", stemmed("term")).groupBy("stem").agg(F.count("*").alias("forms"), F.sum("n").alias("occurrences"))


def q35_refresh_anti(spark, d):
    """Filings of even doc_id are held; the rest are listed anew."""
    f = filings(spark, d).select("doc_id", "ticker", "form", "filed")
    return service.new_filings(f, f.filter("doc_id % 2 = 0"))


def q36_merge_chunks(spark, d):
    units = filings(spark, d).select(F.md5("text").alias("chunk_id"), "doc_id")
    first = units.filter("doc_id % 2 = 0").groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"))
    new = units.filter("doc_id % 2 = 1").groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"))
    return chunks.merged(first, new)


def _listed(spark, d):
    f = filings(spark, d)
    return f.select("ticker", "form", "filed", F.date_sub(F.to_date("filed"), 40).cast("string").alias("report_date"), F.col("doc_id").alias("at"))


def q37_select_filings(spark, d):
    """Every benchmark item wants one filing; every third names a quarter."""
    b = table(spark, d, "benchmark")
    wanted = b.select(
        F.col("item_id").alias("wid"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("ticker"), F.lit("10-K").alias("form"),
        (2015 + F.col("item_id") % 9).cast("int").alias("year"), F.when(F.col("item_id") % 3 == 0, (F.col("item_id") % 4 + 1).cast("int")).alias("quarter"),
    )
    return service.chosen_filings(wanted, _listed(spark, d)).select("wid", "form", "report_date", "filed", F.col("at").alias("place"))


def q38_first_n_per_form(spark, d):
    rows = _listed(spark, d).withColumn("page", F.lit(0))
    return first_per_form(rows, {"10-K": 2, "10-Q": 4}, "ticker").select("ticker", "form", "filed", F.col("at").alias("place"), "nth")


def q44_latest_filing(spark, d):
    f = _listed(spark, d)
    return service.latest_filing(f, q01_coverage(spark, d).filter("form <> '10-Q'"))


def _picked(values, times: int, key: str = "doc_id"):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) * times % len(values) + 1).cast("int"))


def _mixed_questions(spark, d):
    """Whole documents with companies, terms, ratios and years that their ids choose from the fixed tables, in changing spellings."""
    name, k = _picked([names[0] for names in COMPANY_NAMES.values()], 1), F.col("doc_id")
    second = F.when(k % 5 == 0, F.concat(F.lit(" and "), F.initcap(_picked([names[0] for names in COMPANY_NAMES.values()], 7)))).when(k % 5 == 1, F.concat(F.lit(" ("), _picked(list(COMPANY_NAMES), 1), F.lit(")"))).otherwise("")
    year = (2001 + k % 23).cast("string")
    when = F.when(k % 7 == 0, F.concat(F.lit("FY"), F.substring(year, 3, 2))).when(k % 7 == 1, F.concat(F.lit("from "), year, F.lit(" to "), (2002 + k % 23).cast("string"), F.lit("."))).when(k % 7 == 2, F.concat(F.lit("$"), year)).when(k % 7 == 3, F.concat(F.lit("Q2 "), year)).otherwise(F.concat(year, F.lit("?")))
    ask = F.concat(F.lit("For "), F.when(k % 3 == 0, F.initcap(name)).otherwise(name), second, F.lit(" show "), _picked(list(SYNONYMS), 5), F.lit(", "), F.upper(_picked(list(RATIO_LINES), 11)), F.lit(" or "), _picked(list(RATIO_LINES), 7), F.lit(" in "), when, F.lit(" "))
    return table(spark, d, "documents").select("doc_id", F.concat(ask, F.coalesce("text", F.lit(""))).alias("q"))


def q46_query_filters(spark, d):
    """What the filters read from questions: company, years, and whether annual reports are meant."""
    a = _mixed_questions(spark, d).withColumn("_y", Q.years(F.col("q")))
    return a.select("doc_id", Q.company(F.col("q")).alias("ticker"), F.array_join("_y", ",").alias("years"), Q.wants_annual(F.col("q"), F.col("_y")).alias("annual"))


def _phrases(spark, d):
    """Questions about a metric, one for each order."""
    parts = ("gross margin and dpo", "free cash flow", "working capital or ROA", "the quick ratio", "net sales of EBITDA", "eps and dividend payout ratio")
    at = F.element_at(F.array(*map(F.lit, parts)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("What is "), at, F.lit(" in "), F.year("o_orderdate").cast("string"), F.lit("?")).alias("q"))


def q47_synonym_expand(spark, d):
    return _mixed_questions(spark, d).select("doc_id", F.md5(Q.expanded(F.col("q"))).alias("digest"), F.length(Q.expanded(F.col("q"))).alias("n_chars"))


def q48_period_parse(spark, d):
    shapes = F.array(*(F.lit(x) for x in ("FY%Y", "%Y", "fiscal %Y", "Q3 %Y", "Q2-FY%Y", "%Y Q4", "FY%y", "latest", "spring")))
    y = F.year("o_orderdate").cast("string")
    shape = F.element_at(shapes, (F.col("o_orderkey") % 9 + 1).cast("int"))
    p = table(spark, d, "orders").select("o_orderkey", F.replace(F.replace(shape, F.lit("%Y"), y), F.lit("%y"), F.substring(y, 3, 2)).alias("p"))
    return p.select("o_orderkey", Q.period(F.col("p")).alias("x")).select("o_orderkey", F.coalesce("x.fy", F.lit(0)).alias("fy"), "x.fp", "x.ok")


def q49_ratio_plan(spark, d):
    return _mixed_questions(spark, d).select("doc_id", F.array_join(Q.ratio_lines(F.col("q")), "; ").alias("lines"))


def q50_clean_question(spark, d):
    text = F.concat(F.lit("Assume that you are an analyst. "), "q", F.when(F.col("o_orderkey") % 2 == 0, " Round your answer to two places.").otherwise(" Answer in millions: is it high?"))
    return _phrases(spark, d).select("o_orderkey", Q.cleaned(text).alias("cleaned"))


def q51_search_terms(spark, d):
    return _questions(spark, d).select("qid", F.array_join(Q.search_terms(F.col("question")), " ").alias("terms"))


def q52_document_names(spark, d):
    n = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("CO_"), F.year("o_orderdate").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"))).otherwise(""), F.when(F.col("o_orderkey") % 5 == 0, "_8K").when(F.col("o_orderkey") % 3 == 0, "_10Q").otherwise("_10K")).alias("name"))
    return n.select("o_orderkey", Q.document_name(F.col("name")).alias("x")).select("o_orderkey", F.coalesce("x.year", F.lit(0)).alias("year"), F.coalesce("x.quarter", F.lit(0)).alias("quarter"), "x.form")


_STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"
F_SQL = """f AS (SELECT doc_id, source AS ticker, CASE lang WHEN 'en' THEN '10-K' WHEN 'de' THEN '10-Q' ELSE '8-K' END AS form,
    CAST(DATE '2015-01-01' + CAST(doc_id % 3650 AS INTEGER) AS VARCHAR) AS filed, coalesce(text, '') AS text FROM documents)"""
B_SQL = F_SQL + """, b AS (SELECT doc_id, ticker, form, filed, CAST(i - 1 AS INTEGER) AS pos, bl[i] AS block, len(regexp_extract_all(bl[i], '\\S+')) AS w
    FROM (SELECT *, unnest(range(1, len(bl) + 1)) AS i FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: length(x) >= 40) AS bl FROM f)))"""
_COVER = B_SQL + ", c AS (SELECT ticker, form, filed, count(*) AS chunks FROM b GROUP BY ALL)"


def _chunk_sql(kind: str, size: int) -> str:
    return f"""WITH RECURSIVE {B_SQL},
r AS (SELECT doc_id, pos, 0 AS nth, w AS n FROM b WHERE pos = 0
      UNION ALL SELECT b.doc_id, b.pos, CASE WHEN r.n >= {size} THEN r.nth + 1 ELSE r.nth END, CASE WHEN r.n >= {size} THEN b.w ELSE r.n + b.w END
      FROM r JOIN b ON b.doc_id = r.doc_id AND b.pos = r.pos + 1),
g AS (SELECT doc_id, nth, any_value(ticker) AS ticker, any_value(form) AS form, any_value(filed) AS filed, string_agg(block, ' ' ORDER BY pos) AS text
      FROM r JOIN b USING (doc_id, pos) GROUP BY doc_id, nth)
SELECT substr(sha256(ticker || '|' || form || '|' || filed || '|{kind}|body|' || text), 1, 32) AS chunk_id, doc_id, CAST(nth AS INTEGER) AS nth,
       CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS words FROM g"""


_POST = F_SQL + """, p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM f) GROUP BY ALL)"""
_QUESTIONS = """q AS (SELECT item_id AS qid, text AS question, 'src' || (item_id % 20) AS ticker, '2015-01-01' AS filed_from,
    (2015 + item_id % 4) || '-12-31' AS filed_to, item_id % 2 = 0 AS annual FROM benchmark)"""
_BM25 = _POST + ", " + _QUESTIONS + f""", dl AS (SELECT f.doc_id, coalesce(sum(tf), 0) AS dl FROM f LEFT JOIN p USING (doc_id) GROUP BY f.doc_id),
    co AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    qt AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM q) WHERE term NOT IN {_STOP}),
    s AS (SELECT qid, doc_id, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
            * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score
          FROM qt JOIN p USING (term) JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN co GROUP BY qid, doc_id),
    kw AS (SELECT * FROM (SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10),
    kf AS (SELECT * FROM (SELECT s.qid, s.doc_id, score, CAST(row_number() OVER (PARTITION BY s.qid ORDER BY score DESC, s.doc_id) AS INTEGER) AS rank
           FROM s JOIN q USING (qid) JOIN f ON f.doc_id = s.doc_id AND f.ticker = q.ticker AND f.filed BETWEEN filed_from AND filed_to) WHERE rank <= 10),
    rx AS (SELECT *, false AS relaxed FROM kf UNION ALL SELECT *, true FROM kw WHERE qid NOT IN (SELECT qid FROM kf))"""
_GROWN = _BM25.replace(" FROM documents)", " FROM documents WHERE doc_id % 7 <> 3)", 1)
_DENSE = """, dn AS (SELECT * FROM (SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank
    FROM (SELECT q.qid, c.vec_id AS doc_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score
          FROM q JOIN embeddings v ON v.vec_id = q.qid CROSS JOIN embeddings c)) WHERE rank <= 10)"""


def _merge_sql(first: str) -> str:
    return f""", m AS (SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY slot) AS INTEGER) AS pos FROM
    (SELECT qid, doc_id, min(slot) AS slot FROM (SELECT qid, doc_id, 2 * rank - 1 AS slot FROM {first} UNION ALL SELECT qid, doc_id, 2 * rank FROM dn) GROUP BY ALL))"""


_RANKED = "WITH " + _BM25 + _DENSE + _merge_sql("rx") + f""", h AS (SELECT m.*, f.ticker, f.form, f.filed, coalesce(f.text, '') AS text, annual,
        bool_or(f.form = '10-K') OVER (PARTITION BY qid) AS has_annual FROM m LEFT JOIN f USING (doc_id) JOIN q USING (qid)),
    h2 AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9$%.]+'), lambda t: t NOT IN {_STOP})) AS terms
           FROM h WHERE NOT (annual AND has_annual AND form IS NOT NULL AND form = '10-Q')),
    h3 AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n, avg(len(terms)) OVER (PARTITION BY qid) AS mean FROM h2),
    a AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest(regexp_extract_all(lower(question), '[a-z0-9$%.]+')) AS term FROM q) WHERE term NOT IN {_STOP}),
    w AS (SELECT a.qid, a.term, ln((any_value(n) + 1) / (count(*) FILTER (list_contains(terms, a.term)) + 1)) + 1e0 AS weight FROM a JOIN h3 USING (qid) GROUP BY a.qid, a.term),
    sc AS (SELECT h3.qid, h3.doc_id, pos, round((sum(weight) FILTER (list_contains(terms, term))) / sum(weight) / (0.25e0 + 0.75e0 * any_value(len(terms)) / any_value(mean)), 6) AS score
           FROM h3 JOIN w USING (qid) GROUP BY h3.qid, h3.doc_id, pos),
    rk AS (SELECT * FROM (SELECT qid, doc_id, coalesce(score, 0) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY coalesce(score, 0) DESC, pos) AS INTEGER) AS rank FROM sc) WHERE rank <= 5)"""
_LISTED = F_SQL + ", l AS (SELECT ticker, form, filed, CAST(CAST(filed AS DATE) - 40 AS VARCHAR) AS report_date, doc_id AS slot FROM f)"
_PHRASE = """o AS (SELECT o_orderkey, 'What is ' || (['gross margin and dpo', 'free cash flow', 'working capital or ROA', 'the quick ratio', 'net sales of EBITDA', 'eps and dividend payout ratio'])[o_orderkey % 6 + 1]
    || ' in ' || year(o_orderdate) || '?' AS q FROM orders)"""

def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_pick(values, times: int) -> str:
    return f"({_sql_list(values)})[doc_id * {times} % {len(values)} + 1]"


def _sql_rows(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)


def _sql_bounded(term: str) -> str:
    """A pattern of a term that stands by itself, in a text with a blank before and after."""
    return "[^a-z0-9](?:" + term + ")[^a-z0-9]"


_CAPITAL = "array_to_string(list_transform(string_split({}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_NAMES = [names[0] for names in COMPANY_NAMES.values()]
_MIXED = f"""m AS (SELECT doc_id, 'For ' || CASE WHEN doc_id % 3 = 0 THEN {_CAPITAL.format(_sql_pick(_NAMES, 1))} ELSE {_sql_pick(_NAMES, 1)} END
      || CASE doc_id % 5 WHEN 0 THEN ' and ' || {_CAPITAL.format(_sql_pick(_NAMES, 7))} WHEN 1 THEN ' (' || {_sql_pick(list(COMPANY_NAMES), 1)} || ')' ELSE '' END || ' show ' || {_sql_pick(list(SYNONYMS), 5)}
      || ', ' || upper({_sql_pick(list(RATIO_LINES), 11)}) || ' or ' || {_sql_pick(list(RATIO_LINES), 7)} || ' in '
      || CASE doc_id % 7 WHEN 0 THEN 'FY' || CAST(2001 + doc_id % 23 AS VARCHAR)[3:4] WHEN 1 THEN 'from ' || (2001 + doc_id % 23) || ' to ' || (2002 + doc_id % 23) || '.' WHEN 2 THEN '$' || (2001 + doc_id % 23)
         WHEN 3 THEN 'Q2 ' || (2001 + doc_id % 23) ELSE (2001 + doc_id % 23) || '?' END || ' ' || coalesce(text, '') AS q FROM documents)"""

QUERIES = {name: f for name, f in list(globals().items()) if name[0] == "q" and name[1:3].isdigit()}

ORACLES = {
    "q01_coverage": f"WITH {_COVER} SELECT * FROM c",
    "q02_covered_companies": f"WITH {_COVER} SELECT ticker, form, min(filed) AS first_filed, max(filed) AS last_filed, count(DISTINCT filed) AS filings FROM c GROUP BY ALL",
    "q03_corpus_totals": f"WITH {B_SQL} SELECT form, count(DISTINCT ticker) AS companies, count(DISTINCT ticker || '|' || form || '|' || filed) AS filings, count(*) AS chunks FROM b GROUP BY GROUPING SETS ((form), ())",
    "q04_text_blocks": f"WITH {B_SQL} SELECT doc_id, pos, CAST(length(block) AS INTEGER) AS n_chars, md5(block) AS digest FROM b",
    "q05_chunk_ids": f"WITH {B_SQL} SELECT doc_id, pos, substr(sha256(ticker || '|' || form || '|' || filed || '|child|body|' || block), 1, 32) AS chunk_id FROM b",
    "q06_child_chunks": _chunk_sql("child", 400),
    "q07_parent_chunks": _chunk_sql("parent", 1500),
    "q08_postings": f"WITH {_POST} SELECT term, doc_id, tf FROM p",
    "q09_bm25_topk": f"WITH {_BM25} SELECT * FROM kw",
    "q10_bm25_filtered": f"WITH {_BM25} SELECT * FROM kf",
    "q11_dense_topk": f"WITH {_QUESTIONS} {_DENSE} SELECT * FROM dn",
    "q66_near_in_groups": f"WITH {_QUESTIONS} {_DENSE} SELECT * FROM dn".replace("CROSS JOIN embeddings c", "CROSS JOIN (SELECT * FROM embeddings WHERE label % 2 = 0) c"),
    "q12_hybrid_merge": f"WITH {_BM25} {_DENSE} {_merge_sql('kw')} SELECT * FROM m",
    "q13_filter_relaxation": f"WITH {_BM25} SELECT * FROM rx",
    "q14_hydrate": f"WITH {_BM25} {_DENSE} {_merge_sql('rx')} SELECT qid, pos, m.doc_id, ticker, form, filed, md5(text) AS digest FROM m LEFT JOIN f USING (doc_id)",
    "q15_lexical_rerank": _RANKED + " SELECT qid, rank, doc_id, score FROM rk",
    "q16_find_passages": _RANKED + """ SELECT qid, rank, rk.doc_id AS id, '[' || ticker || ' ' || form || ' ' || filed || ']' AS citation,
        md5(CASE WHEN length(text) > 8000 THEN substr(text, 1, 8000) || ' [... truncated]' ELSE text END) AS digest,
        CAST(length(CASE WHEN length(text) > 8000 THEN substr(text, 1, 8000) || ' [... truncated]' ELSE text END) AS INTEGER) AS n_chars FROM rk JOIN f USING (doc_id)""",
    "q62_grown_index": f"WITH {_GROWN} SELECT * FROM kw",
    "q63_merged_index": f"WITH {_GROWN} SELECT * FROM rx",
    # for pages of the kind in the tables: one box, then an article of headings and paragraphs, some of them left open
    "q29_html_blocks": r"""WITH a AS (SELECT page_id, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)</head>.*?(<div.*</article>)', 1), '</?(?:div|h1|p)(?:\s[^>]*)?>|</article>') AS x FROM pages),
        t AS (SELECT page_id, list_filter(list_transform(x, lambda s: array_to_string(list_filter(list_transform(regexp_split_to_array(s, '<[^>]*>'),
                lambda y: regexp_replace(regexp_replace(regexp_replace(y, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '^\s+|\s+$', '', 'g')), lambda y: y <> ''), ' ')), lambda s: length(s) >= 40) AS b FROM a)
        SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, CAST(length(b[i]) AS INTEGER) AS n_chars, md5(b[i]) AS digest FROM (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM t)""",
    "q64_typed_tables": """WITH o AS (SELECT *, bool_or(o_orderkey % 4 = 0) OVER c AS gaps, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place,
            bool_or(o_orderkey % 3 = 2) OVER c AS words, CAST(round(o_totalprice, 2) AS DOUBLE) AS price FROM orders WINDOW c AS (PARTITION BY o_custkey))
        SELECT o_custkey, 'order|price|rank|open|Unnamed: 4' AS headers, CAST(place AS INTEGER) AS place, concat_ws('|', o_orderkey, CAST(price AS VARCHAR),
            CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderkey % 1000 || CASE WHEN gaps THEN '.0' ELSE '' END END, CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END,
            CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN CASE WHEN words THEN printf('%.2f', price) ELSE CAST(price AS VARCHAR) END ELSE 'as agreed' END) AS cells FROM o""",
    "q35_refresh_anti": f"WITH {F_SQL} SELECT doc_id, ticker, form, filed FROM f WHERE (ticker, filed) NOT IN (SELECT (ticker, filed) FROM f WHERE doc_id % 2 = 0)",
    "q36_merge_chunks": """WITH u AS (SELECT md5(text) AS chunk_id, doc_id FROM documents), a AS (SELECT chunk_id, min(doc_id) AS doc_id FROM u WHERE doc_id % 2 = 0 GROUP BY 1),
        n AS (SELECT chunk_id, min(doc_id) AS doc_id FROM u WHERE doc_id % 2 = 1 GROUP BY 1) SELECT * FROM a UNION ALL SELECT * FROM n WHERE chunk_id NOT IN (SELECT chunk_id FROM a)""",
    "q37_select_filings": f"""WITH {_LISTED}, w AS (SELECT item_id AS wid, 'src' || (item_id % 20) AS ticker, '10-K' AS form, 2015 + item_id % 9 AS y, CASE WHEN item_id % 3 = 0 THEN item_id % 4 + 1 END AS qu FROM benchmark)
        SELECT wid, form, report_date, filed, slot AS place FROM (SELECT w.wid, l.form, l.report_date, l.filed, l.slot, row_number() OVER (PARTITION BY wid ORDER BY slot) AS n
        FROM w JOIN l ON w.ticker = l.ticker AND w.form = l.form AND year(CAST(report_date AS DATE)) = y AND (qu IS NULL OR quarter(CAST(report_date AS DATE)) = qu)) WHERE n = 1""",
    "q38_first_n_per_form": f"""WITH {_LISTED} SELECT ticker, form, filed, slot AS place, nth FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ticker, form ORDER BY slot) AS INTEGER) AS nth FROM l)
        WHERE nth <= CASE form WHEN '10-K' THEN 2 WHEN '10-Q' THEN 4 ELSE 0 END""",
    "q44_latest_filing": f"""WITH {_COVER}, l AS (SELECT ticker, form, filed, doc_id AS slot FROM f), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, form ORDER BY filed DESC, slot) AS n FROM l) WHERE n = 1)
        SELECT n.ticker, n.form, n.filed, (n.ticker, n.form, n.filed) IN (SELECT (ticker, form, filed) FROM c WHERE form <> '10-Q') AS covered FROM n""",
    "q46_query_filters": f"""WITH {_MIXED}, c(ticker, names) AS (VALUES {_sql_rows([(t, _sql_bounded("|".join(map(re.escape, names)))) for t, names in COMPANY_NAMES.items()])}),
        n AS (SELECT doc_id, ticker FROM m, c WHERE regexp_matches(' ' || lower(q) || ' ', names)
              UNION SELECT doc_id, t FROM (SELECT doc_id, unnest(regexp_split_to_array(q, '[^A-Za-z0-9]+')) AS t FROM m) WHERE length(t) BETWEEN 2 AND 5 AND t IN (SELECT ticker FROM c)),
        y AS (SELECT doc_id, list_concat(list_filter(list_transform(regexp_extract_all(q, '[0-9,.$]+'), lambda r: regexp_extract(r, '^((?:19|20)[0-9]{{2}})(?:[.$]|$)', 1)), lambda r: r <> ''),
                list_transform(regexp_extract_all(q, '(?i)\\bFY\\s?(\\d{{2}})\\b', 1), lambda r: '20' || r)) AS y, regexp_matches(q, '{Q.INTERIM}') AS interim FROM m)
        SELECT doc_id, (SELECT CASE WHEN count(*) = 1 THEN max(ticker) END FROM n WHERE n.doc_id = y.doc_id) AS ticker, array_to_string(y, ',') AS years, len(y) > 0 AND NOT interim AS annual FROM y""",
    "q47_synonym_expand": f"""WITH {_MIXED}, s(i, term, wording, head) AS (VALUES {_sql_rows([(i, t, w, w.split()[0]) for i, (t, w) in enumerate(SYNONYMS.items())])}),
        f AS (SELECT doc_id, wording, min(i) AS i FROM m, s WHERE contains(lower(q), term) AND NOT contains(lower(q), head) GROUP BY ALL),
        a AS (SELECT doc_id, string_agg(wording, ' ' ORDER BY i) AS more FROM f GROUP BY doc_id)
        SELECT doc_id, md5(q || coalesce(' ' || more, '')) AS digest, CAST(length(q || coalesce(' ' || more, '')) AS INTEGER) AS n_chars FROM m LEFT JOIN a USING (doc_id)""",
    "q48_period_parse": """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 9 < 7 THEN year(o_orderdate) + CASE WHEN o_orderkey % 9 = 6 AND year(o_orderdate) < 2000 THEN 100 ELSE 0 END ELSE 0 END AS INTEGER) AS fy,
        (['FY', 'FY', 'FY', 'Q3', 'Q2', 'Q4', 'FY', 'FY', NULL])[o_orderkey % 9 + 1] AS fp, o_orderkey % 9 <> 8 AS ok FROM orders""",
    "q49_ratio_plan": f"""WITH {_MIXED}, r(i, term, part, line) AS (VALUES {_sql_rows([(i, _sql_bounded(re.escape(t)), j, line) for i, (t, lines) in enumerate(RATIO_LINES.items()) for j, line in enumerate(lines)])}),
        h AS (SELECT doc_id, line, i, part, length(regexp_extract(' ' || lower(q) || ' ', '(?s)^(.*?)' || term, 1)) AS place FROM m, r WHERE regexp_matches(' ' || lower(q) || ' ', term)),
        o AS (SELECT doc_id, line, min((place, i, part)) AS o FROM h GROUP BY ALL)
        SELECT doc_id, coalesce(string_agg(line, '; ' ORDER BY o), '') AS lines FROM m LEFT JOIN o USING (doc_id) GROUP BY doc_id""",
    "q50_clean_question": f"WITH {_PHRASE} SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN q ELSE q || ' is it high?' END AS cleaned FROM o",
    "q51_search_terms": f"""SELECT item_id AS qid, coalesce(string_agg(t, ' ' ORDER BY i), '') AS terms FROM (SELECT item_id, t, min(i) AS i FROM
        (SELECT item_id, unnest(x) AS t, unnest(range(len(x))) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS x FROM benchmark)) WHERE t NOT IN {_STOP} GROUP BY 1, 2) GROUP BY 1""",
    "q52_document_names": """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 <> 0 THEN year(o_orderdate) ELSE 0 END AS INTEGER) AS year, CAST(CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0 THEN quarter(o_orderdate) ELSE 0 END AS INTEGER) AS quarter,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN '10-Q' ELSE '10-K' END AS form FROM orders""",
}
