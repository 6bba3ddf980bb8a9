"""Queries over reported figures: picks, derived values, differences, comparison, verification, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import figures as G
from quillstone.operators import evaluate, facts, pages, verify
from quillstone.sources.filings import filings, order_facts, table

# Metrics of the stand-in facts, with their concepts in order of preference.
PREFERENCES = {"urgency": ("URGENT", "HIGH"), "calm": ("LOW", "NOT SPECIFIED", "MEDIUM")}


def _metrics(spark):
    rows = [(m, c, i) for m, cs in PREFERENCES.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "metric string, concept string, prio int")


def _requests(spark, d, latest=True):
    """Every customer is asked for both metrics, in its latest year or in 1996."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("cik"))
    fy = F.lit(None).cast("int") if latest else F.lit(1996)
    c = c.select("cik", F.explode(F.array(*map(F.lit, PREFERENCES))).alias("metric"), fy.alias("fy"), F.lit("FY").alias("fp"))
    return c.withColumn("rid", F.concat_ws("/", "cik", "metric"))


def _answers(spark, d, latest=True):
    return facts.lookup(_requests(spark, d, latest), facts.values(order_facts(spark, d)), _metrics(spark))


def q17_fact_pick(spark, d):
    return facts.values(order_facts(spark, d)).select("cik", "concept", "fy", "fp", F.round("val", 2).alias("val"), "end", "filed", "kind", F.coalesce("note", F.lit("")).alias("note"))


def q18_priority_coalesce(spark, d):
    out = _answers(spark, d).select("rid", F.coalesce("concept", F.lit("")).alias("concept"), F.coalesce("fy", F.lit(0)).alias("fy"), F.coalesce("display", F.lit("")).alias("display"), F.coalesce("error", F.lit("")).alias("error"))
    return out


def q19_q4_derived(spark, d):
    out = facts.values(order_facts(spark, d)).filter("fp = 'Q4'")
    return out.select("cik", "concept", "fy", F.round("val", 2).alias("val"), F.coalesce("start", F.lit("")).alias("start"), "end", "kind")


def q20_derived_difference(spark, d):
    """The urgent figure less the calm one, for each customer's orders of 1996."""
    out = facts.differences(_answers(spark, d, False), {"pressure": ("urgency", "calm")})
    return out.select("cik", "fy", F.round("val", 2).alias("val"), "formula", "id")


def q21_compare_pivot(spark, d):
    out = facts.compared(_answers(spark, d, False).filter("error IS NULL"), list(PREFERENCES))
    return out.select("cik", "fy", *(F.coalesce(F.format_number(m, 2), F.lit("none")).alias(m) for m in PREFERENCES))


def q22_suggest(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("cik"), F.lit("total of high or low").alias("metric"), F.lit(1996).alias("fy"), F.lit("FY").alias("fp"))
    return facts.suggestions(c.withColumn("rid", F.col("cik").cast("string")), facts.values(order_facts(spark, d)))


def _drafts(spark, d):
    """A draft answer for each order: its total in full, a rounded one, a share, and a wrong figure."""
    o = table(spark, d, "orders")
    total = F.format_number("o_totalprice", 2)
    answer = F.concat(F.lit("Sales were $"), total, F.lit(", about $"), F.format_number(F.col("o_totalprice") / 1000, 1), F.lit(" thousand, up 3.5% from $"), F.format_number(F.col("o_totalprice") + 1, 0), F.lit("."))
    source = F.concat(F.lit("Net sales | $ | ("), total, F.lit(") | 3.5 | % |"))
    return o.select(F.col("o_orderkey").alias("id"), answer.alias("answer"), F.array(source).alias("sources"), F.array("o_totalprice").alias("values"), "o_totalprice", "o_orderstatus")


def _joined(df, *cols):
    return df.select("id", *(F.array_join(c, "; ").alias(c) for c in cols))


def q23_extract_figures(spark, d):
    return _joined(_drafts(spark, d).select("id", G.figures(F.col("answer")).alias("figures")), "figures")


def q24_check_figures(spark, d):
    return _joined(verify.check_text(_drafts(spark, d)), "grounded", "not_found")


def q25_tolerance_match(spark, d):
    return _joined(verify.check_values(_drafts(spark, d)), "grounded", "not_found")


def q26_verify_combined(spark, d):
    """Each draft cites one passage, one fact and, every fifth, an id that is not there."""
    drafts = _drafts(spark, d)
    key = F.col("id").cast("string")
    none = F.when(F.col("id") % 5 == 0, F.concat(F.lit("gone-"), key))
    ids = F.array_compact(F.array(F.when(F.col("id") % 2 == 0, F.concat(F.lit("p-"), key)), F.concat(F.lit("xbrl:"), key), none))
    passages = drafts.select(F.concat(F.lit("p-"), key).alias("key"), F.element_at("sources", 1).alias("text"))
    tagged = drafts.select(F.concat(F.lit("xbrl:"), key).alias("key"), F.col("o_totalprice").alias("val"))
    out = verify.combined(drafts.select("id", "answer", ids.alias("ids")), passages, tagged)
    return out.select("id", *(F.array_join(c, "; ").alias(c) for c in ("grounded", "not_found", "unknown_ids")), "checked_against")


def q60_figure_ids(spark, d):
    """Of each customer's ids, a reported figure, a difference, a metric without a recipe and an unknown company, those that name a figure."""
    cik = F.col("c_custkey").cast("string")
    ticker = F.translate(cik, "0123456789", "ABCDEFGHIJ")
    ids = F.array(F.concat(F.lit("xbrl:"), ticker, F.lit(":us-gaap:URGENT:FY1996")), F.concat(F.lit("derived:"), cik, F.lit(":pressure:FY1996")), F.concat(F.lit("derived:"), cik, F.lit(":weight:FY1996")), F.concat(F.lit("xbrl:"), F.lit("Z"), F.lit(":us-gaap:URGENT:FY1996")))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("cik"), ticker.alias("ticker"), ids.alias("ids"))
    cited = c.select(F.explode("ids").alias("key")).distinct()
    known = facts.values_of(cited, facts.values(order_facts(spark, d)), c.select("ticker", "cik"), _metrics(spark), {"pressure": ("urgency", "calm")})
    return cited.join(known, "key", "left").select("key", F.col("val").isNotNull().alias("known"), F.coalesce(F.round("val", 2), F.lit(0.0)).alias("val"))


def q45_redact(spark, d):
    return verify.redacted(_drafts(spark, d)).select("id", "redacted")


def _table_texts(spark, d):
    """A text table for each customer: orders by priority and year."""
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    cells = o.groupBy("o_custkey", "o_orderpriority").agg(*(F.coalesce(F.format_number(F.sum(F.when(F.col("y") == y, F.floor("o_totalprice"))), 0), F.lit("")).alias(f"y{y}") for y in (1995, 1996)))
    line = F.concat_ws(" | ", "o_orderpriority", "y1995", "y1996")
    t = cells.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"))
    text = F.concat(F.lit("(In units) | 1995 | 1996\n"), "lines")
    return t.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"), F.lit("10-K").alias("form"), F.lit("1997-02-01").alias("filed"), text.alias("text"))


def q27_row_facts(spark, d):
    return pages.row_facts(_table_texts(spark, d)).select("chunk_id", "text", "ticker")


def q28_table_repair(spark, d):
    """Tables as a flattening leaves them: numbered header, symbols and copies in columns of their own."""
    o = table(spark, d, "orders")
    v, w = F.format_number("o_totalprice", 1), F.format_number(F.col("o_totalprice") / 2, 1)
    text = F.concat(F.lit("0 | 1 | 2 | 3 | 4 | 5 | 6\n | 2020.0 | 2020.0 |  | 2019 | 2019 | \nNet sales | $ | "), v, F.lit(" |  | $ | "), w, F.lit(" | \nShare | 3.5 | % |  | 2.5 | % | "))
    return o.select("o_orderkey", pages.repaired(text).alias("text"))


def _relevance(spark, d):
    """Labelled documents as answers to questions: the day's documents in order of length, good ones relevant."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return docs.select((F.col("doc_id") % 25).alias("qid"), F.row_number().over(_by_length()).alias("rank"), (F.col("quality") == 0).alias("relevant"))


def _by_length():
    from pyspark.sql import Window as W

    return W.partitionBy(F.col("doc_id") % 25).orderBy(F.desc("n_chars"), "doc_id")


def q39_hit_mrr(spark, d):
    ranked = _relevance(spark, d)
    return evaluate.hits(ranked, ranked.select("qid").distinct())


def _judged(spark, d):
    """Answers of known kinds: right, scaled, wrong, refused, empty, without numbers."""
    o = table(spark, d, "orders")
    n = F.floor("o_totalprice").cast("string")
    kind = F.col("o_orderkey") % 6
    answer = (
        F.when(kind == 0, F.concat(F.lit("It was $"), n)).when(kind == 1, F.concat(F.lit("It was $"), n, F.lit(" million"))).when(kind == 2, F.concat(F.lit("It was $"), F.floor(F.col("o_totalprice") * 3).cast("string")))
        .when(kind == 3, F.concat(F.lit("The context does not provide $"), n)).when(kind == 4, "").otherwise("It rose.")
    )
    truth = F.when(F.col("o_orderkey") % 7 == 0, "no figure").otherwise(F.concat(F.lit("$"), n, F.lit(".00")))
    contexts = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("sales | "), n)).otherwise("nothing of note")
    return o.select("o_orderkey", answer.alias("answer"), truth.alias("truth"), contexts.alias("contexts"), (F.col("o_orderkey") % 4).alias("calls"), "o_orderpriority", F.year("o_orderdate").alias("year"))


def q40_failure_buckets(spark, d):
    a = _judged(spark, d)
    kind = evaluate.bucket(F.col("o_orderpriority") != "5-LOW", F.col("year") != 1995, F.col("answer"), F.col("truth"), F.col("contexts"))
    return a.select(kind.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def q41_three_way(spark, d):
    return evaluate.three_way(_judged(spark, d))


def q42_numeric_precision(spark, d):
    return evaluate.numeric_precision(_judged(spark, d), ["o_orderpriority"])


def q43_evidence_cover(spark, d):
    """Whether two of three lines of an order, as text, hold the figures of its evidence, every other line."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.floor("l_extendedprice").cast("string"))).alias("x"))
    evidence = F.array_join(F.filter("x", lambda v, i: i % 2 == 0), " and ")
    chunk = F.array_join(F.filter("x", lambda v, i: i % 3 != 0), " | ")
    wanted = G.evidence_numbers(G.evaluated_numbers(evidence))
    return li.select("l_orderkey", G.covers(G.evidence_numbers(G.evaluated_numbers(chunk)), wanted).alias("covered"))


def q53_has_filing(spark, d):
    wanted = table(spark, d, "documents").select(F.col("source").alias("ticker"), F.lit("10-K").alias("form"), (2014 + F.col("doc_id") % 12).cast("int").alias("year")).distinct()
    return evaluate.has_filing(wanted, filings(spark, d))


def q54_display(spark, d):
    o = table(spark, d, "orders")
    unit = F.element_at(F.array(*map(F.lit, ("USD", "USD/shares", "shares"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    v = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") * 100).otherwise(F.col("o_totalprice"))
    return o.select("o_orderkey", G.shown(F.when(F.col("o_orderkey") % 5 == 0, -v).otherwise(v), unit).alias("display"))


QUERIES = {name: f for name, f in list(globals().items()) if name[0] == "q" and name[1:3].isdigit()}

_FACTS = """fa AS (SELECT o_custkey AS cik, substr(o_orderpriority, 3) AS concept, 'Total of ' || lower(substr(o_orderpriority, 3)) AS label, o_orderkey AS slot, o_totalprice AS val,
    CAST(year(o_orderdate) AS INTEGER) AS fy, CAST(o_orderdate AS DATE) AS d, CASE WHEN month(o_orderdate) <= 3 THEN 'Q1' WHEN month(o_orderdate) <= 6 THEN 'Q2' WHEN month(o_orderdate) <= 9 THEN 'Q3' ELSE 'FY' END AS fp FROM orders),
  fb AS (SELECT *, CASE WHEN slot % 7 = 0 THEN NULL WHEN fp = 'FY' THEN 364 WHEN fp = 'Q3' AND slot % 3 = 0 THEN 272 WHEN slot % 5 = 0 THEN 200 ELSE 91 END AS days,
    slot % 11 = 0 AS amended, CAST(d + CAST(slot % 120 AS INTEGER) AS VARCHAR) AS filed, CAST(d AS VARCHAR) AS fin FROM fa),
  fc AS (SELECT *, bool_and(days IS NULL) OVER (PARTITION BY cik, concept) AS instant, coalesce(days, 0) AS n, CAST(d - coalesce(days, 0) AS VARCHAR) AS begun FROM fb),
  yr AS (SELECT * FROM (SELECT *, 'annual' AS kind, row_number() OVER (PARTITION BY cik, concept, fy ORDER BY fin DESC, amended, filed, slot) AS r FROM fc WHERE fp = 'FY' AND (instant OR n BETWEEN 350 AND 380)) WHERE r = 1),
  qa AS (SELECT * FROM (SELECT *, 'quarter' AS kind, row_number() OVER (PARTITION BY cik, concept, fy, fp ORDER BY fin DESC, amended, filed, slot) AS r FROM fc WHERE fp <> 'FY' AND (instant OR n BETWEEN 80 AND 100)) WHERE r = 1),
  qb AS (SELECT * FROM (SELECT *, 'to_date' AS kind, row_number() OVER (PARTITION BY cik, concept, fy, fp ORDER BY fin DESC, amended, filed, slot) AS r FROM fc WHERE fp <> 'FY' AND NOT instant AND n BETWEEN 100 AND 290) WHERE r = 1),
  ni AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, concept, fy ORDER BY fin DESC, amended, filed, slot) AS r FROM fc WHERE fp = 'Q3' AND n BETWEEN 250 AND 290) WHERE r = 1),
  v AS (SELECT cik, concept, label, fy, fp, val, CASE WHEN days IS NOT NULL THEN begun END AS begun, fin, filed, kind, n FROM yr
    UNION ALL SELECT cik, concept, label, fy, fp, val, CASE WHEN days IS NOT NULL THEN begun END, fin, filed, kind, n FROM qa
    UNION ALL SELECT cik, concept, label, fy, fp, val, begun, fin, filed, kind, n FROM qb WHERE (cik, concept, fy, fp) NOT IN (SELECT (cik, concept, fy, fp) FROM qa)
    UNION ALL SELECT cik, concept, label, fy, 'Q4', val, NULL, fin, filed, 'year_end', n FROM yr WHERE instant
    UNION ALL SELECT yr.cik, yr.concept, yr.label, yr.fy, 'Q4', yr.val - ni.val, ni.fin, yr.fin, yr.filed, 'derived', yr.n FROM yr JOIN ni USING (cik, concept, fy) WHERE NOT yr.instant)"""
_PREFER = """pr(metric, concept, prio) AS (VALUES ('urgency', 'URGENT', 0), ('urgency', 'HIGH', 1), ('calm', 'LOW', 0), ('calm', 'NOT SPECIFIED', 1), ('calm', 'MEDIUM', 2))"""
_SHOW = "CASE WHEN abs({v}) >= 1e6 THEN '$' || format('{{:,.1f}}', {v} / 1e6) || ' million' ELSE '$' || format('{{:,.0f}}', {v}) END"


def _answer_sql(fy: str) -> str:
    return f"""WITH {_FACTS}, {_PREFER}, rq AS (SELECT c_custkey AS cik, metric, c_custkey || '/' || metric AS rid FROM customer, (SELECT DISTINCT metric FROM pr)),
  ny AS (SELECT rid, max(v.fy) AS fy FROM rq JOIN pr USING (metric) JOIN v ON v.cik = rq.cik AND v.concept = pr.concept AND v.fp = 'FY' GROUP BY rid),
  an AS (SELECT * FROM (SELECT rq.rid, rq.cik, metric, v.concept, v.fy, v.val, row_number() OVER (PARTITION BY rq.rid ORDER BY prio) AS r FROM rq JOIN ny USING (rid) JOIN pr USING (metric)
         JOIN v ON v.cik = rq.cik AND v.concept = pr.concept AND v.fp = 'FY' AND v.fy = {fy}) WHERE r = 1)"""


_DRAFT = """t AS (SELECT o_orderkey AS id, format('{:,.2f}', o_totalprice) AS a, format('{:,.1f}', o_totalprice / 1000) AS b, format('{:,.0f}', o_totalprice + 1) AS c, o_totalprice AS p FROM orders)"""
_N = "CAST(replace({x}, ',', '') AS DOUBLE)"
_WRONG = "abs({n}) = p"
_JUDGED = """j AS (SELECT o_orderkey AS k, floor(o_totalprice) AS n, o_orderpriority, year(o_orderdate) AS y, o_orderkey % 7 <> 0 AND floor(o_totalprice) > 1.5 AS truth, o_orderkey % 2 = 0 AS held, o_orderkey % 4 AS calls FROM orders)"""

ORACLES = {
    "q53_has_filing": """WITH f AS (SELECT source AS ticker, CASE lang WHEN 'en' THEN '10-K' WHEN 'de' THEN '10-Q' ELSE '8-K' END AS form, CAST(DATE '2015-01-01' + CAST(doc_id % 3650 AS INTEGER) AS VARCHAR)[1:4] AS y FROM documents),
        w AS (SELECT DISTINCT source AS ticker, '10-K' AS form, CAST(2014 + doc_id % 12 AS INTEGER) AS year FROM documents)
        SELECT ticker, form, year, EXISTS (SELECT 1 FROM f WHERE f.ticker = w.ticker AND f.form = w.form AND CAST(f.y AS INTEGER) BETWEEN w.year AND w.year + 2) AS has_filing FROM w""",
    "q17_fact_pick": f"""WITH {_FACTS} SELECT cik, concept, fy, fp, round(val, 2) AS val, fin AS "end", filed, kind, CASE WHEN kind = 'to_date' THEN CAST(round(n / 30.4) AS INTEGER) || ' months' ELSE '' END AS note FROM v""",
    "q18_priority_coalesce": _answer_sql("ny.fy") + f""" SELECT rid, coalesce(concept, '') AS concept, coalesce(an.fy, 0) AS fy, coalesce({_SHOW.format(v='val')}, '') AS display,
        CASE WHEN concept IS NULL THEN 'No value for ' || rq.metric || ' in FY latest; years with annual values: ' || coalesce((SELECT array_to_string(list_reverse_sort(list_distinct(list(fy)))[1:8], ', ') FROM v WHERE v.cik = rq.cik AND fp = 'FY'), 'none') ELSE '' END AS error
        FROM rq LEFT JOIN an USING (rid)""",
    "q19_q4_derived": f"""WITH {_FACTS} SELECT cik, concept, fy, round(val, 2) AS val, coalesce(begun, '') AS start, fin AS "end", kind FROM v WHERE fp = 'Q4'""",
    "q20_derived_difference": _answer_sql("1996") + f""" SELECT a.cik, a.fy, round(a.val - abs(b.val), 2) AS val, 'urgency ' || {_SHOW.format(v='a.val')} || ' minus calm ' || {_SHOW.format(v='b.val')} AS formula,
        'derived:' || a.cik || ':pressure:FY1996' AS id FROM an a JOIN an b ON a.cik = b.cik AND a.metric = 'urgency' AND b.metric = 'calm'""",
    "q21_compare_pivot": _answer_sql("1996") + """ SELECT cik, fy, coalesce(format('{:,.2f}', max(val) FILTER (metric = 'urgency')), 'none') AS urgency, coalesce(format('{:,.2f}', max(val) FILTER (metric = 'calm')), 'none') AS calm FROM an GROUP BY cik, fy""",
    "q22_suggest": f"""WITH {_FACTS}, s AS (SELECT CAST(cik AS VARCHAR) AS rid, concept, label, val, CAST(contains(lower(concept || ' ' || label), 'total') AS INTEGER) + CAST(contains(lower(concept || ' ' || label), 'high') AS INTEGER) + CAST(contains(lower(concept || ' ' || label), 'low') AS INTEGER) AS h FROM v WHERE fp = 'FY' AND fy = 1996)
        SELECT rid, CAST(row_number() OVER (PARTITION BY rid ORDER BY h DESC, length(concept), concept) AS INTEGER) AS rank, 'us-gaap:' || concept AS concept, label, {_SHOW.format(v='val')} AS value FROM s WHERE h > 0""",
    "q23_extract_figures": f"WITH {_DRAFT} SELECT id, array_to_string(regexp_extract_all('Sales were $' || a || ', about $' || b || ' thousand, up 3.5% from $' || c || '.', '\\$\\d[\\d,]*(?:\\.\\d+)?(?:\\s?(?:billion|million|thousand|B|M|K))?\\b|\\d+(?:\\.\\d+)?%|\\b\\d{{1,3}}(?:,\\d{{3}})+(?:\\.\\d+)?\\b'), '; ') AS figures FROM t",
    "q24_check_figures": f"""WITH {_DRAFT}, s AS (SELECT *, {_N.format(x='b')} = {_N.format(x='a')} OR {_N.format(x='b')} = 3.5 AS bok, {_N.format(x='c')} = {_N.format(x='a')} AS cok FROM t)
        SELECT id, '$' || a || CASE WHEN bok THEN '; $' || b || ' thousand' ELSE '' END || '; 3.5%' || CASE WHEN cok THEN '; $' || c ELSE '' END AS grounded,
        array_to_string(list_filter([CASE WHEN NOT bok THEN '$' || b || ' thousand' END, CASE WHEN NOT cok THEN '$' || c END], lambda x: x IS NOT NULL), '; ') AS not_found FROM s""",
    "q25_tolerance_match": f"""WITH {_DRAFT}, s AS (SELECT *, abs({_N.format(x='b')} * 1e3 - p) <= 0.05 * 1e3 + 1e-9 AS bok, len(list_filter([1, 1e3, 1e6, 1e9], lambda k: abs({_N.format(x='c')} * k - p) <= 0.5 * k + 1e-9)) > 0 AS cok,
          len(list_filter([1, 1e3, 1e6, 1e9], lambda k: abs({_N.format(x='a')} * k - p) <= 0.005 * k + 1e-9)) > 0 AS aok FROM t)
        SELECT id, array_to_string(list_filter([CASE WHEN aok THEN '$' || a END, CASE WHEN bok THEN '$' || b || ' thousand' END, CASE WHEN cok THEN '$' || c END], lambda x: x IS NOT NULL), '; ') AS grounded,
        array_to_string(list_filter([CASE WHEN NOT aok THEN '$' || a END, CASE WHEN NOT bok THEN '$' || b || ' thousand' END, '3.5%', CASE WHEN NOT cok THEN '$' || c END], lambda x: x IS NOT NULL), '; ') AS not_found FROM s""",
    "q26_verify_combined": f"""WITH {_DRAFT}, s AS (SELECT *, id % 2 = 0 AS pas, abs({_N.format(x='b')} * 1e3 - p) <= 0.05 * 1e3 + 1e-9 OR (id % 2 = 0 AND {_N.format(x='b')} IN ({_N.format(x='a')}, 3.5)) AS bok,
          len(list_filter([1, 1e3, 1e6, 1e9], lambda k: abs({_N.format(x='c')} * k - p) <= 0.5 * k + 1e-9)) > 0 OR (id % 2 = 0 AND {_N.format(x='c')} = {_N.format(x='a')}) AS cok FROM t)
        SELECT id, array_to_string(list_filter(['$' || a, CASE WHEN bok THEN '$' || b || ' thousand' END, CASE WHEN pas THEN '3.5%' END, CASE WHEN cok THEN '$' || c END], lambda x: x IS NOT NULL), '; ') AS grounded,
        array_to_string(list_filter([CASE WHEN NOT bok THEN '$' || b || ' thousand' END, CASE WHEN NOT pas THEN '3.5%' END, CASE WHEN NOT cok THEN '$' || c END], lambda x: x IS NOT NULL), '; ') AS not_found,
        CASE WHEN id % 5 = 0 THEN 'gone-' || id ELSE '' END AS unknown_ids, 1 + CAST(pas AS BIGINT) AS checked_against FROM s""",
    "q60_figure_ids": _answer_sql("1996") + """, k AS (SELECT 'xbrl:' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') || ':us-gaap:URGENT:FY1996' AS key, c_custkey AS cik, 'own' AS what FROM customer
            UNION ALL SELECT 'derived:' || c_custkey || ':pressure:FY1996', c_custkey, 'made' FROM customer UNION ALL SELECT 'derived:' || c_custkey || ':weight:FY1996', c_custkey, 'no' FROM customer
            UNION ALL SELECT DISTINCT 'xbrl:Z:us-gaap:URGENT:FY1996', 0, 'no' FROM customer),
        m AS (SELECT a.cik, 'made' AS what, a.val - abs(b.val) AS val FROM an a JOIN an b ON a.cik = b.cik AND a.metric = 'urgency' AND b.metric = 'calm'
            UNION ALL SELECT cik, 'own', val FROM v WHERE concept = 'URGENT' AND fp = 'FY' AND fy = 1996)
        SELECT key, val IS NOT NULL AS known, coalesce(round(val, 2), 0) AS val FROM k LEFT JOIN m USING (cik, what)""",
    "q45_redact": f"""WITH {_DRAFT}, s AS (SELECT *, {_N.format(x='b')} = {_N.format(x='a')} OR {_N.format(x='b')} = 3.5 AS bok, {_N.format(x='c')} = {_N.format(x='a')} AS cok FROM t)
        SELECT id, 'Sales were $' || a || ', about ' || CASE WHEN bok THEN '$' || b || ' thousand' ELSE '[exact figure unavailable in retrieved context]' END || ', up 3.5% from ' || CASE WHEN cok THEN '$' || c ELSE '[exact figure unavailable in retrieved context]' END || '.' AS redacted FROM s""",
    "q27_row_facts": """WITH s AS (SELECT o_custkey AS c, o_orderpriority AS p, sum(floor(o_totalprice)) FILTER (year(o_orderdate) = 1995) AS a, sum(floor(o_totalprice)) FILTER (year(o_orderdate) = 1996) AS b FROM orders GROUP BY ALL),
        t AS (SELECT 'C' || c AS ticker, 'C' || c || ' 10-K filed 1997-02-01: ' || p || ': 1995: ' || format('{:,.0f}', a) || '; 1996: ' || format('{:,.0f}', b) AS text FROM s
              WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b AND NOT regexp_matches(format('{:,.0f}', a), '^(19|20)\\d{2}$') AND NOT regexp_matches(format('{:,.0f}', b), '^(19|20)\\d{2}$'))
        SELECT 'fact_' || substr(sha256(text), 1, 32) AS chunk_id, text, ticker FROM t""",
    "q28_table_repair": """SELECT o_orderkey, ' | 2020 | 2019' || chr(10) || 'Net sales | $' || regexp_replace(format('{:,.1f}', o_totalprice), '^(\\d+)\\.0$', '\\1') || ' | $' || regexp_replace(format('{:,.1f}', o_totalprice / 2), '^(\\d+)\\.0$', '\\1') || chr(10) || 'Share | 3.5% | 2.5%' AS text FROM orders""",
    "q39_hit_mrr": """WITH r AS (SELECT doc_id % 25 AS qid, row_number() OVER (PARTITION BY doc_id % 25 ORDER BY n_chars DESC, doc_id) AS rank, quality = 0 AS ok FROM documents JOIN labels USING (doc_id)),
        f AS (SELECT qid, min(rank) FILTER (ok) AS f FROM r GROUP BY qid)
        SELECT count(*) AS n, round(avg(CASE WHEN f <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN f <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_5, round(avg(CASE WHEN f <= 10 THEN 1.0 ELSE 0 END), 6) AS hit_10,
        round(avg(CASE WHEN f <= 20 THEN 1.0 ELSE 0 END), 6) AS hit_20, round(avg(coalesce(1 / f, 0)), 6) AS mrr FROM f""",
    "q40_failure_buckets": f"""WITH {_JUDGED} SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'out_of_scope' WHEN y = 1995 THEN 'no_filing_in_corpus' WHEN NOT truth THEN 'no_numeric_truth'
          WHEN k % 6 IN (0, 1) THEN 'correct' WHEN k % 6 = 3 AND held THEN 'refused_data_in_ctx' WHEN k % 6 = 3 THEN 'refused_retrieval' WHEN held THEN 'wrong_in_ctx' ELSE 'wrong_retrieval' END AS bucket, count(*) AS n FROM j GROUP BY 1""",
    "q41_three_way": f"""WITH {_JUDGED} SELECT count(*) AS n, count(*) FILTER (truth) AS scorable, count(*) FILTER (truth AND k % 6 IN (0, 1)) AS right_answers, count(*) FILTER (truth AND k % 6 IN (2, 5)) AS wrong_answers,
          count(*) FILTER (truth AND k % 6 IN (3, 4)) AS refused, count(*) FILTER (k % 6 IN (3, 4)) AS refused_all, round(avg(calls), 2) AS avg_calls,
          round(count(*) FILTER (truth AND k % 6 IN (0, 1)) / count(*) FILTER (truth AND k % 6 IN (0, 1, 2, 5)), 3) AS right_when_answering FROM j""",
    "q42_numeric_precision": f"""WITH {_JUDGED}, s AS (SELECT *, k % 6 = 3 AS r, CASE WHEN k % 6 IN (4, 5) THEN 1.0 WHEN k % 6 IN (0, 3) AND held THEN 1.0 ELSE 0.0 END AS p FROM j)
        SELECT o_orderpriority, count(*) AS n, round(avg(CASE WHEN r THEN 1.0 ELSE 0 END), 6) AS refusal_rate, round(avg(p), 6) AS precision_all, round(avg(p) FILTER (NOT r), 6) AS precision_answered, round(avg(p) FILTER (r), 6) AS precision_refused FROM s GROUP BY ALL""",
    "q43_evidence_cover": """WITH x AS (SELECT l_orderkey, list_sort(list(CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR))) AS x FROM lineitem GROUP BY ALL),
        n AS (SELECT l_orderkey, list_distinct(list_filter(list_transform(list_filter(x, lambda s, i: i % 2 = 1), lambda s: CAST(s AS DOUBLE)), lambda n: n >= 100 AND NOT (n BETWEEN 1990 AND 2035))) AS w,
              list_filter(list_transform(list_filter(x, lambda s, i: i % 3 <> 1), lambda s: CAST(s AS DOUBLE)), lambda n: n >= 100 AND NOT (n BETWEEN 1990 AND 2035)) AS h FROM x)
        SELECT l_orderkey, len(w) > 0 AND len(list_filter(w, lambda a: len(list_filter(h, lambda b: abs(a - b) / greatest(abs(a), 1e-9) <= 0.001)) > 0)) >= least(3, len(w)) AS covered FROM n""",
    "q54_display": """WITH s AS (SELECT o_orderkey, o_orderkey % 3 AS u, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 1 END * CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 100 ELSE o_totalprice END AS v FROM orders)
        SELECT o_orderkey, CASE u WHEN 0 THEN CASE WHEN v < 0 THEN '-' ELSE '' END || CASE WHEN abs(v) >= 1e6 THEN '$' || format('{:,.1f}', abs(v) / 1e6) || ' million' ELSE '$' || format('{:,.0f}', abs(v)) END
          WHEN 1 THEN '$' || format('{:,.2f}', v) || ' per share' ELSE CASE WHEN abs(v) >= 1e6 THEN format('{:,.1f}', v / 1e6) || ' million shares' ELSE format('{:,.0f}', v) || ' shares' END END AS display FROM s""",
}
