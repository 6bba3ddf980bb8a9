"""Operators on fixtures."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.functions.text import excerpt, tidied
from quillstone.operators import chunks, evaluate, facts, index, ingest, neighbours, pages, retrieve, segments, service, tools, vectors, verify
from quillstone.sources import filings

UNITS = [
    ("c1", "MMM", "10-K", "2019-02-07", "Purchases of property, plant and equipment (PP&E) | 1,577 | 1,373"),
    ("c2", "NVDA", "10-K", "2023-02-24", "Nvidia data center revenue grew with demand for accelerators in the year"),
    ("c3", "AAPL", "10-Q", "2023-05-05", "Apple services revenue rose in the quarter on the App Store"),
    ("c4", "TSLA", "10-K", "2023-01-31", "Tesla automotive gross margin fell as prices were cut in the year"),
]


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(UNITS, "chunk_id string, ticker string, form string, filed string, text string")


def search(units, question, **more):
    return [r.id for r in tools.search_filings(units, question, **more).orderBy("rank").collect()]


def test_search(units):
    assert search(units, "Nvidia data center revenue")[0] == "c2"
    assert search(units, "property plant equipment spending")[0] == "c1"
    assert search(units, "what is the")[:1] == []
    assert search(units, 'NEAR("x" AND -text: OR *') == []
    assert search(units, "gross margin of Tesla FY2022") == ["c4"]
    assert search(units, "revenue", ticker="AAPL") == ["c3"]
    assert search(units, "Pfizer revenue")[:2]  # a filter read from the question that finds nothing is dropped
    with pytest.raises(ValueError):
        tools.search_filings(units, "x" * 501)


def test_stemmed_index(units):
    posted = index.postings(units, stem=True)
    assert {r.chunk_id for r in posted.filter("term = 'purchas'").collect()} == {"c1"}


def test_index_round_trip(spark, units, tmp_path):
    path = str(tmp_path)
    index.write_index(units.limit(1), path)
    index.write_index(units, path)
    loaded = index.load(spark, path)
    assert loaded.corpus.collect()[0].n == 4 and loaded.stem and loaded.corpus.count() == 1
    assert search(units, "a purchase of equipment", loaded=loaded) == ["c1"]
    index.lookup_tables(units, path)
    assert [r.chunk_id for r in index.by_ids(spark, path, ["c2", "gone"]).collect()] == ["c2"]
    assert index.coverage(spark, path).count() == 4
    index.lookup_tables(units.limit(2), path)
    assert index.coverage(spark, path).count() == 2
    first = index.load(spark, path)
    assert len(index.forget(spark, path)) == 1 and index.forget(spark, path) == [] and index.load(spark, path).postings.count() == first.postings.count()


def test_search_notes_and_relaxation(spark, units):
    more = units.unionByName(spark.createDataFrame([("c5", "AAPL", "10-K", "2021-10-29", "Apple revenue of services in the annual report")], units.schema))
    note = lambda df: tools.search_result(df).first()
    got = note(tools.search_filings(more, "services revenue", ticker="aapl", year=2015))
    assert {p.id for p in got.passages} == {"c5"} and got.note.endswith("No filing matches 2015; these passages are from other years.")
    got = note(tools.search_filings(more, "zebra"))
    assert got.passages == [] and got.note == tools.NO_MATCH
    got = note(tools.search_filings(more, "accelerators", ticker="AAPL"))
    assert got.passages == []  # never another company's
    vectors = spark.createDataFrame([("c2", [1.0, 0.0]), ("c3", [0.0, 1.0])], "chunk_id string, v array<double>")
    got = note(tools.search_filings(more, "zebra", vectors=vectors, embed=lambda q: [0.0, 1.0]))
    assert [p.id for p in got.passages][0] == "c3" and got.note is None
    placed = neighbours.place(vectors)
    for asked in ({}, {"ticker": "NVDA"}):
        plain, pruned = (note(tools.search_filings(more, "zebra", vectors=v, embed=lambda q: [0.0, 1.0], **asked)) for v in (vectors, placed))
        assert plain == pruned
    picked = tools.search_filings(more, "revenue", rank=lambda h, q, top, key: h.filter("chunk_id = 'c3'").withColumn("rank", F.lit(1)), budget=10**6).collect()
    assert [r.id for r in picked] == ["c3"]
    over = tools.search_filings(more, "revenue", rank=lambda *a: 1 / 0, budget=1).first()
    assert tools.OVER_BUDGET in over.note
    assert tools.search_filings(more, "revenue", stage="candidates").count() >= 3
    cover = chunks.coverage(more)
    with pytest.raises(ValueError, match="not covered"):
        tools.search_filings(more, "revenue", ticker="ZZZ", cover=cover)


def test_interleaving(spark):
    rank = lambda ids: spark.createDataFrame([(0, c, i) for i, c in enumerate(ids, 1)], "qid int, chunk_id string, rank int")
    got = retrieve.interleaved(rank(["c1", "c2"]), rank(["c2", "c3"])).orderBy("pos").collect()
    assert [r.chunk_id for r in got] == ["c1", "c2", "c3"]
    assert retrieve.interleaved(rank("abc"), rank("defghijk")).count() == 11


def test_interim_reports(spark):
    rows = lambda forms: spark.createDataFrame([(0, f) for f in forms], "qid int, form string")
    left = lambda forms, want: sorted(r.form for r in retrieve.without_interim(rows(forms), F.lit(want)).collect())
    assert left(["10-K", "10-Q"], True) == ["10-K"] and left(["10-K", "10-Q"], False) == ["10-K", "10-Q"] and left(["10-Q", "8-K"], True) == ["10-Q", "8-K"]


def test_item_winners(spark):
    base = spark.createDataFrame([(0, "a", 1), (0, "b", 2)], "qid int, chunk_id string, pos int")
    win = spark.createDataFrame([(0, 0, 1, "a"), (0, 0, 2, "c"), (0, 1, 1, "c"), (0, 1, 2, "d"), (0, 2, 1, "e")], "qid int, line int, rank int, chunk_id string")
    assert [r.chunk_id for r in retrieve.item_winners(base, win, cap=4).orderBy("pos").collect()] == ["a", "b", "c", "d"]


TABLE = "\n".join(
    ["0 | 1 | 2 | 3 | 4 | 5 | 6 | 7 | 8", "(In millions) | (In millions) | 2020.0 | 2020 | 2020 |  | 2019 | 2019 | 2019", "Net sales | Net sales | $ | 12467.5 | 12467.5 |  | $ | 9458.2 | 9458.2", "Dividend | Dividend | 0.20 | 0.20 | 0.20 |  | 0.20 | 0.20 | 0.20", "Loss | Loss | (17 | (17 | ) |  | 3.5 | 3.5 | %"]
)


def test_table_repair(spark):
    pairs = [
        (TABLE, "(In millions) | 2020 | 2019\nNet sales | $12467.5 | $9458.2\nDividend | 0.20 | 0.20\nLoss | (17) | 3.5%"), ("plain text", "plain text"), ("2020 | 2019\n1 | 2", "2020 | 2019\n1 | 2"),
        ("0 | 1 | 2\na | 2026 | 2026.0\nb | 5 | 5", "a | 2026\nb | 5"), ("0 | 1 | 2\nx | 2020 | 2019\ny |  | 7", "x | 2020 | 2019\ny |  | 7"), ("0 | 1", ""), ("", ""), (None, None), ("0 | 1\na\nb | c | d\n |  ", "a\nb | c | d"),
    ]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(pairs)], "i int, t string").select("i", pages.repaired(F.col("t")).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [want for _, want in pairs]


def test_new_facts(spark):
    text = "(In millions) | 2020 | 2019\nNet sales | 12 | 9"
    rows = [("t1", "table", "T", "10-K", "2020-08-01", text), ("t2", "table", "T", "10-K", "2020-08-01", text), ("t3", "table", "T", "10-Q", "2020-08-01", text), ("c", "child", "T", "10-K", "2020-08-01", text)]
    held = spark.createDataFrame(rows, "chunk_id string, chunk_type string, ticker string, form string, filed string, text string")
    fresh = pages.new_facts(held)
    assert fresh.count() == 1 and pages.new_facts(held.unionByName(fresh.select(*held.columns))).count() == 0


def test_tidied_texts_and_excerpts(spark):
    text = "0 | 1 | 2\nNet sales |  | Net sales\xa0| $ | 1,577\n | 1577 | 1577"
    row = spark.range(1).select(tidied(F.lit(text)).alias("t"), excerpt(F.lit(text), F.array(F.lit("$1,577 million"))).alias("e"), excerpt(F.lit("word " * 100 + "1577 end"), F.array(F.lit("none"), F.lit("1,577"))).alias("f")).first()
    assert row.t == "Net sales | $ | 1,577 | 1577" and row.e == row.t and row.f.startswith("...") and row.f.endswith("1577 end") and len(row.f) == 3 + 120 + 8


def test_html():
    html = "<div><p>" + "word " * 12 + "<p>short<div><span>" + "inner text " * 6 + "</span></div></div><script>" + "x " * 50 + "</script>"
    assert pages.blocks_of(html) == [("word " * 12).strip(), ("inner text " * 6).strip()]
    assert pages.blocks_of(None) == [] and pages.tables_of("") == []
    table = "<table><tr><th rowspan=2>A<th colspan=2>2020</tr><tr><td>1<td></tr></table><table><tr><td>one column</table>"
    assert pages.tables_of(table) == [{"headers": ["A", "2020", "2020.1"], "rows": [["A", "1", ""]]}]


HEAD = "<tr><th>a</th><th>b</th></tr>"
CELLS = [
    (["1", "2"], ["1", "2"]), (["1", ""], ["1.0", ""]), (["2020", "n/a"], ["2020.0", ""]), (["3.10", "1,234"], ["3.1", "1234.0"]), (["1,234", "12,345"], ["1234", "12345"]),
    (["1,234", "x"], ["1234", "x"]), (["$1,234", "(1,234)"], ["$1,234", "(1,234)"]), (["007", "+5"], ["7", "5"]), (["1e3", "-.5"], ["1000.0", "-0.5"]), (["TRUE", "false"], ["True", "False"]),
    (["True", ""], ["True", ""]), (["NULL", "None"], ["", ""]), (["5%", "7"], ["5%", "7"]), (["-", "7"], ["-", "7"]), (["inf", "1"], ["inf", "1.0"]), (["99999999999999999999", "1"], ["1e+20", "1.0"]),
]


@pytest.mark.parametrize("given, wanted", CELLS)
def test_cells_are_typed_by_column(given, wanted):
    table = f"<table>{HEAD}" + "".join(f"<tr><td>k</td><td>{x}</td></tr>" for x in given) + "</table>"
    assert pages.tables_of(table) == [{"headers": ["a", "b"], "rows": [["k", x] for x in wanted]}]


def test_heads_spans_and_what_is_hidden():
    one = lambda html: pages.tables_of(f"<table>{html}</table>")
    body = "<tr><td>k</td><td>1<sup>a</sup></td></tr>"
    assert one(f"<thead><tr><td>x</td><td>x</td></tr></thead>{body}") == [{"headers": ["x", "x.1"], "rows": [["k", "1a"]]}]
    assert one(f"<tr><th></th><th>y</th></tr>{body}") == [{"headers": ["Unnamed: 0", "y"], "rows": [["k", "1a"]]}]
    assert one(f"<tr><th colspan=2>t</th></tr><tr><th>x</th><th></th></tr>{body}")[0]["headers"] == ["('t', 'x')", "('t', 'Unnamed: 1_level_1')"]
    assert one("<tr><td rowspan=2>k</td><td>1</td></tr><tr><td>2<br>3</td></tr><tfoot><tr><td>sum</td><td>3</td></tr></tfoot>") == [{"headers": ["0", "1"], "rows": [["k", "1"], ["k", "2 3"], ["sum", "3"]]}]
    assert one("<tr style='display: none'><td>a</td><td>b</td></tr><tr><td>c</td><td style='display:none'>x</td><td>d <b style='display:none'>e</b></td></tr>") == [{"headers": ["0", "1"], "rows": [["c", "d"]]}]
    assert one(HEAD) == [] and one("<tr><td>only</td></tr>") == []
    rows = "".join(f"<tr><td>{i}</td><td>r</td></tr>" for i in range(1500))
    assert one(f"<tr><td rowspan=1501>all</td><td>0</td><td>r</td></tr>{rows}")[0]["rows"][-1] == ["all", "1499", "r"]


def test_row_facts(spark):
    text = "(In millions) | 2020 | 2019\nNet sales | 12,467.5 | 9,458.2\nSame | 5 | 5\nMore | 1 | 2 | 3\nFiscal year | 1 | 2\nLoss | (17) | 3.5%"
    t = spark.createDataFrame([("T", "10-K", "2020-08-01", text), ("T", "10-K", "x", "no header | 1 | 2")], "ticker string, form string, filed string, text string")
    got = sorted(r.text for r in pages.row_facts(t).collect())
    assert got == ["T 10-K filed 2020-08-01: Loss: 2020: (17); 2019: 3.5%", "T 10-K filed 2020-08-01: Net sales: 2020: 12,467.5; 2019: 9,458.2"]


def fact(concept, fp, start, end, val, fy=2023, form=None, filed="2024-02-01", unit="USD", namespace="us-gaap"):
    return (1, namespace, concept, concept, unit, 0, 0, start, end, float(val), fy, fp, form or ("10-K" if fp == "FY" else "10-Q"), filed, "a")


FACTS = [
    fact("SalesRevenueNet", "FY", "2022-10-02", "2023-09-30", 33_723_297_000), fact("SalesRevenueNet", "FY", "2021-10-02", "2022-09-30", 1), fact("SalesRevenueNet", "FY", "2022-10-02", "2023-09-30", 2, form="10-K/A", filed="2023-12-01"),
    fact("SalesRevenueNet", "Q3", "2023-04-01", "2023-06-30", 8_541_668_000), fact("SalesRevenueNet", "Q3", "2022-10-02", "2023-06-30", 24_890_000_000),
    fact("CashFlow", "Q3", "2022-10-02", "2023-06-30", 5e9), fact("Assets", "FY", None, "2023-09-30", 77), fact("Assets", "Q1", None, "2022-12-31", 70),
    fact("NetCashProvidedByUsedInOperatingActivities", "FY", "2022-10-02", "2023-09-30", 7_622_853_000), fact("PaymentsToAcquirePropertyPlantAndEquipment", "FY", "2022-10-02", "2023-09-30", 348_552_000),
    fact("EarningsPerShareDiluted", "FY", "2022-10-02", "2023-09-30", 12.03, unit="USD/shares"), fact("EarningsPerShareDiluted", "FY", "2022-10-02", "2023-09-30", 9, namespace="ifrs-full"),
]


@pytest.fixture(scope="module")
def tagged(spark):
    return spark.createDataFrame(FACTS, "cik long, namespace string, concept string, label string, unit string, unit_at int, at int, start string, end string, val double, fy int, fp string, form string, filed string, accn string")


def test_fact_picks(tagged):
    got = {(r.concept, r.fp): r for r in facts.values(tagged).collect()}
    assert got["SalesRevenueNet", "FY"].val == 33_723_297_000
    assert got["SalesRevenueNet", "Q3"].val == 8_541_668_000
    assert got["SalesRevenueNet", "Q4"].val == 8_833_297_000 and got["SalesRevenueNet", "Q4"].start == "2023-06-30" and got["SalesRevenueNet", "Q4"].kind == "derived"
    assert got["CashFlow", "Q3"].val == 5e9 and got["CashFlow", "Q3"].note == "9 months"
    assert got["Assets", "Q4"].val == got["Assets", "FY"].val == 77 and got["Assets", "Q1"].val == 70
    assert got["EarningsPerShareDiluted", "FY"].val == 12.03


def test_financials(spark, tagged):
    ask = lambda metrics, period="FY2023": {r.metric: r for r in tools.company_financials(tagged, {"T": 1}, ["t"], metrics, period).collect()}
    got = ask(["revenue", "operating cash flow", "capex", "goodwill", "eps", "free cash flow", "cash flow of the year"])
    assert got["revenue"].display == "$33,723.3 million" and got["eps diluted"].display == "$12.03 per share"
    assert "2023" in got["goodwill"].error and got["goodwill"].val is None
    assert ask(["revenue"], "latest")["revenue"].fy == 2023 and ask(["revenue"], "FY2015")["revenue"].error
    assert (got["revenue"].id, got["revenue"].citation, got["revenue"].url) == ("xbrl:T:us-gaap:SalesRevenueNet:FY2023", "[T 10-K 2024-02-01]", "https://www.sec.gov/Archives/edgar/data/1/a/")
    free = got["free cash flow"]
    assert free.val == 7_274_301_000 and free.formula == "operating cash flow $7,622.9 million minus capital expenditure $348.6 million" and [x.val for x in free.inputs] == [7_622_853_000, 348_552_000]
    assert "us-gaap:CashFlow" not in [x.concept for x in got["cash flow of the year"].suggestions] and got["cash flow of the year"].suggestions  # it has no value for the year
    both = tools.company_financials(tagged, {"T": 1}, ["T"], ["operating cash flow", "capex"], "2023")
    free = facts.differences(both).collect()
    assert [(r.metric, r.val, r.id) for r in free] == [("free cash flow", 7_274_301_000, "derived:1:free cash flow:FY2023")]
    with pytest.raises(ValueError):
        tools.company_financials(tagged, {"T": 1}, ["T"], ["revenue"], "soon")


def test_fallback_and_comparison(spark, tagged):
    rows = [fact("LiabilitiesAndStockholdersEquity", "FY", None, "2023-09-30", 379_680), fact("StockholdersEquity", "FY", None, "2023-09-30", 92_430)]
    some = tagged.unionByName(spark.createDataFrame(rows, tagged.schema))
    got = tools.company_financials(some, {"T": 1}, ["T"], ["total liabilities", "free cash flow"], "FY2023").orderBy("metric").collect()
    assert [(r.metric, r.val, r.error) for r in got] == [("free cash flow", 7_274_301_000.0, None), ("total liabilities", 379_680.0 - 92_430, None)]
    missing = tools.company_financials(some, {"T": 1}, ["T"], ["free cash flow"], "FY2015").first()
    assert missing.val is None and missing.error.count("No value") == 2
    got = tools.compare_companies(some, {"T": 1, "U": 2}, ["u", "T", "ZZ", "U"], ["revenue", "eps"], "FY2023").collect()
    assert [(r.ticker, r.line, r.val) for r in got] == [("U", 1, None), ("U", 2, None), ("T", 1, 33_723_297_000.0), ("T", 2, 12.03), ("ZZ", 1, None), ("ZZ", 2, None)]
    assert "number" in got[4].error
    for few in (["T"], ["T", "t"], list("ABCDEF")):
        with pytest.raises(ValueError):
            tools.compare_companies(some, {"T": 1}, few, ["revenue"])


def test_suggestions(spark, tagged):
    ask = spark.createDataFrame([("r", 1, "operating cash flow activities", 2023, "FY")], "rid string, cik long, metric string, fy int, fp string")
    assert [r.concept for r in facts.suggestions(ask, facts.values(tagged)).collect()] == ["us-gaap:NetCashProvidedByUsedInOperatingActivities"]


def test_fact_ids(spark):
    df = spark.createDataFrame([("T", "us-gaap", "Assets", "Q4", 2023)], "t string, n string, c string, p string, y int")
    made = df.select(facts.fact_id(*(F.col(x) for x in ("t", "n", "c", "p", "y"))).alias("id")).select("id", facts.parsed_id(F.col("id")).alias("x")).first()
    assert made.id == "xbrl:T:us-gaap:Assets:Q42023" and tuple(made.x) == ("T", "us-gaap", "Assets", "Q4", 2023)


def test_company_facts_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"cik":1,"facts":{"us-gaap":{"Assets":{"label":"Assets","units":{"USD":[{"end":"2023-09-30","val":5,"fy":2023,"fp":"FY","form":"10-K","filed":"2023-11-01","accn":"x"}]}}}}}')
    got = filings.flat_facts(filings.read_company_facts(spark, str(tmp_path))).first()
    assert (got.cik, got.namespace, got.concept, got.unit, got.start, got.val) == (1, "us-gaap", "Assets", "USD", None, 5.0)


def test_listing(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"cik":1,"form":["10-K","10-Q","10-K","10-K"],"reportDate":["a","b","c","d"],"filingDate":["1","2","3","4"],"accessionNumber":["x","x","x","x"],"primaryDocument":["p","p","p","p"]}')
    rows = filings.listing(filings.read_submissions(spark, str(tmp_path)).withColumn("page", F.lit(0)))
    assert sorted(r.filed for r in filings.first_per_form(rows, {"10-K": 2}).collect()) == ["1", "3"]


def test_company_numbers(spark):
    table = lambda rows: spark.createDataFrame(rows, "ticker string, cik long")
    got = filings.company_numbers(table([("aapl", 0), ("SQ", 0), ("ZZ", 0)]).select("ticker"), table([("AAPL", 320193)]), table([("SQ", 5), ("AAPL", 9)]))
    assert {r.ticker: r.cik for r in got.collect()} == {"aapl": 320193, "SQ": 5, "ZZ": None}


def test_redaction(spark):
    a = spark.createDataFrame([(1, "It was $9,999 or $9,999.99, up 5%.", ["9,999.99 and 5"])], "id int, answer string, sources array<string>")
    gone = "[exact figure unavailable in retrieved context]"
    assert verify.redacted(a).first().redacted == f"It was {gone} or $9,999.99, up 5%."


def test_verify_figures(spark, tagged):
    passages = spark.createDataFrame([("c1", "$ | (1,577)")], "key string, text string")
    out = tools.verify_figures("Capex $1,577 million, sales $33.7 billion, not $5,000.", ["c1", "xbrl:T:us-gaap:SalesRevenueNet:FY2023", "gone"], passages, facts.values(tagged), {"T": 1}).first()
    assert (out.grounded, out.not_found, out.unknown_ids, out.checked_against) == (["$1,577 million", "$33.7 billion"], ["$5,000"], ["gone"], 2)


def test_hits(spark):
    ranked = spark.createDataFrame([("A", 1, False), ("A", 3, True), ("A", 4, True), ("B", 1, False)], "qid string, rank int, relevant boolean")
    got = evaluate.hits(ranked, ranked.select("qid").distinct()).first()
    assert (got.n, got.hit_1, got.hit_5, got.mrr) == (2, 0.0, 0.5, round(1 / 6, 6))


def test_three_way(spark):
    rows = [("It was $5,000", "$5000", 2), ("cannot determine 5000", "$5000", 2), ("", "$5000", 2), ("$7,000", "$5000", 2), ("yes", "no number", 2)]
    got = evaluate.three_way(spark.createDataFrame(rows, "answer string, truth string, calls int")).first()
    assert (got.n, got.scorable, got.right_answers, got.wrong_answers, got.refused, got.refused_all, got.right_when_answering) == (5, 4, 1, 1, 2, 2, 0.5)


def test_metric_means(spark):
    got = evaluate.metric_means(spark.createDataFrame([(1.0,), (float("nan"),), (None,), (0.0,)], "f double"), ["f"]).first()
    assert (got.f, got.f_scored, got.n) == (0.5, 2, 4)


def test_call_limits(spark):
    rows = [(i, f"2024-01-01 00:00:{i % 60:02d}") for i in range(31)] + [(100, "2024-01-01 00:01:00")]
    got = {r.id: (r.allowed, r.reason, r.retry_after) for r in service.call_limits(spark.createDataFrame(rows, "id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    assert got[29] == (True, None, None) and got[30] == (False, "minute", 30) and got[100][0]
    day = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00") for i in range(6)], "id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.allowed for r in service.call_limits(day, 30, 4).orderBy("id").collect()] == [True] * 4 + [False] * 2


def test_budget_counts_only_what_it_grants(spark):
    rows = [(1, "2024-01-01 00:00:00", 60), (2, "2024-01-01 00:00:01", 50), (3, "2024-01-01 00:00:02", 40), (4, "2024-01-02 00:00:00", 100)]
    df = spark.createDataFrame(rows, "id long, ts string, tokens long").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r.id: r.granted for r in service.budget(df, 100).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_cache(spark):
    key = lambda args: spark.range(1).select(service.cache_key(F.lit("t"), F.lit(args), "v").alias("k")).first().k
    assert key("Net  Sales ") == key("net sales") != key("sales")
    rows = [(1, "2024-01-01 00:00:00", True), (2, "2024-01-01 01:00:00", True), (3, "2024-01-02 00:00:00", False), (4, "2024-01-02 00:00:01", True), (5, "2024-01-02 00:00:02", True)]
    df = spark.createDataFrame(rows, "id long, ts string, clean boolean").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("key", F.lit("k"))
    assert {r.id: r.hit for r in service.cache_hits(df).collect()} == {1: False, 2: True, 3: False, 4: False, 5: True}


def test_publish_guard_and_merge(spark):
    f = lambda rows: spark.createDataFrame(rows, "ticker string, form string, filed string")
    assert service.publishable(f([("A", "10-K", "1"), ("B", "10-K", "2")]), f([("A", "10-K", "1")])).count() == 1
    c = lambda rows: spark.createDataFrame(rows, "chunk_id string, text string")
    assert sorted(r.text for r in chunks.merged(c([("a", "old")]), c([("a", "new"), ("b", "x"), ("b", "x")])).collect()) == ["old", "x"]


def test_filing_chunks(spark):
    f = spark.createDataFrame([(1, "T", "10-K", "2020-01-01", "\n".join([" ".join(["word"] * 100)] * 5))], "doc_id long, ticker string, form string, filed string, text string")
    t = spark.createDataFrame([("T", "10-K", "2020-01-01", ["0", "1"], [["a", "b"]])], "ticker string, form string, filed string, headers array<string>, rows array<array<string>>")
    got = chunks.filing_chunks(f, t).groupBy("chunk_type").count().collect()
    assert {r.chunk_type: r["count"] for r in got} == {"parent": 1, "child": 2, "table": 1}


def test_guards_and_log(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", "t", f" A{i % 2} ", i != 1) for i in range(6)]
    calls = spark.createDataFrame(rows, "id long, ts string, tool string, arguments string, clean boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.id: (r.rate_limited, r.cache_hit, r.worked) for r in service.guarded(calls, "v", a_minute=5).collect()}
    assert got == {0: (False, False, True), 1: (False, False, True), 2: (False, True, False), 3: (False, False, True), 4: (False, True, False), 5: (True, False, False)}
    made = spark.createDataFrame([("2024-01-01 00:00:00", "t", "x" * 600, 5, [("B",), (None,), ("A",)], {"C": [1.0, 2.0], "D": []}, False, False, None), ("2023-01-01 00:00:00", "t", None, 5, None, None, False, True, "E")], "ts string, tool string, arguments string, latency_ms int, passages array<struct<ticker:string>>, figures map<string,array<double>>, cache_hit boolean, rate_limited boolean, error string").withColumn("ts", F.col("ts").cast("timestamp"))
    service.append_log(service.log_records(made), f"{tmp_path}/log")
    row = service.live_log(spark, f"{tmp_path}/log", "2024-02-01 00:00:00").collect()
    assert [(len(r.arguments), r.n_passages, r.n_figures, r.tickers) for r in row] == [(500, 3, 2, ["A", "B", "C"])]


def test_registry_and_resumption(spark):
    old = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y")], "key string, value double, file string")
    new = spark.createDataFrame([("a", None), ("b", 3.0), ("c", 4.0)], "key string, value double")
    assert sorted(tuple(r) for r in service.registry(old, new).fillna("").collect()) == [("a", 1.0, "x"), ("b", 3.0, "y"), ("c", 4.0, "")]
    items = spark.createDataFrame([(0, "q0"), (1, "q1")], "at int, question string")
    done = spark.createDataFrame([("q1", "yes")], "question string, answer string")
    assert [r.question for r in service.pending(items, done).collect()] == ["q0"]
    assert [r.answer for r in service.resumed(items, done).collect()] == [None, "yes"]


def test_vectors(spark):
    chunks_ = spark.createDataFrame([("a", "T", "x" * 2000, None), ("b", "T", "y" * 10, 2), ("c", "T", "z", 3), ("d", "U", None, 4)], "chunk_id string, ticker string, text string, page int")
    got = {r.chunk_id: r.request for r in vectors.packed(chunks_, "ticker", "chunk_id", tokens=1003, items=2).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 0}
    v = vectors.embedded(vectors.packed(chunks_, "ticker", "chunk_id"), lambda texts: [[float(len(t))] for t in texts], "ticker")
    made = {r.id: r for r in vectors.records(chunks_, v).collect()}
    assert list(made["a"]["values"]) == [2000.0] and len(made["a"].metadata["text"]) == 1000 and set(made["a"].metadata) == {"ticker", "text"} and made["b"].metadata["page"] == "2"
    held = vectors.records(chunks_, v)
    assert vectors.upserted(held, held.filter("id = 'a'")).count() == 4


def test_evaluation_of_items(spark):
    cover = spark.createDataFrame([("T", "10-K", "2020-02-01")], "ticker string, form string, filed string")
    q = spark.createDataFrame([("q1", "T", "10-K", 2019, "$5,000"), ("q2", "T", "10-K", 2010, "$5,000"), ("q3", "T", "10-K", 2019, "no number")], "question string, ticker string, form string, year int, truth string")
    assert [r.question for r in evaluate.scorable(q, cover).collect()] == ["q1"]
    docs = spark.createDataFrame([("q1", ["sales 1,234 and 5,678"]), ("q3", [])], "question string, evidence array<string>")
    assert [r.question for r in evaluate.with_evidence(q, docs, cover).collect()] == ["q1"]
    ranked = spark.createDataFrame([("q1", 1, "1,234 only"), ("q1", 2, "1234 | 5678 | 2019")], "qid string, rank int, text string")
    hit = evaluate.evidence_hits(ranked, docs.withColumnRenamed("question", "qid").filter("qid = 'q1'")).first()
    assert (hit.n, hit.hit_1, hit.hit_5) == (1, 0.0, 1.0)
    answers = spark.createDataFrame([("It was $5,000", "$5,000", ["5,000"]), ("cannot determine", "$5,000", ["x"]), ("It was $7,000", "$5,000", ["x"])], "answer string, truth string, sources array<string>")
    s = evaluate.summary(answers).first()
    assert (s.n, s.refused, s.true_in_answers, s.wrong_in_answers, s.zero_not_found, s.total_not_found) == (3, 1, 1, 1, 2, 1)
    names = spark.createDataFrame([("X_2018Q2_10Q", "T"), ("X_2019_10K", "T"), ("odd", "T")], "name string, ticker string")
    assert [[tuple(d) for d in r.wanted] for r in evaluate.by_ticker(names).collect()] == [[(2018, 2, "10-Q"), (2019, None, "10-K")]]


def test_sources_on_disk(spark, tmp_path):
    (tmp_path / "first").mkdir()
    (tmp_path / "older").mkdir()
    page = lambda *f: '{"form":["%s"],"reportDate":["r"],"filingDate":["%s"],"accessionNumber":["a"],"primaryDocument":["d"]}' % f
    (tmp_path / "first" / "c.json").write_text('{"cik":1,"filings":{"recent":%s,"files":[{"name":"p1.json"},{"name":"p2.json"}]}}' % page("10-K", "3"))
    (tmp_path / "older" / "p1.json").write_text(page("10-Q", "2"))
    (tmp_path / "older" / "p2.json").write_text(page("8-K", "1"))
    rows = filings.listing(filings.full_history(spark, f"{tmp_path}/first", f"{tmp_path}/older")).orderBy("page").collect()
    assert [(r.page, r.form, r.filed) for r in rows] == [(0, "10-K", "3"), (1, "10-Q", "2"), (2, "8-K", "1")]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.html").write_text("<p>\u00e9</p>", encoding="utf-8")
    assert filings.read_documents(spark, f"{tmp_path}/raw").first().html == "<p>\u00e9</p>"
    c = lambda rows: spark.createDataFrame(rows, "chunk_id string, text string, ticker string, form string, filed string, chunk_type string")
    path = f"{tmp_path}/chunks"
    wanted = spark.createDataFrame([("A",), ("B",)], "ticker string")
    assert filings.seeded(spark, wanted, path).count() == 2
    filings.write_chunks(c([("1", "t", "A", "10-K", "f", "child"), ("2", "t", "B", "10-K", "f", "child")]), path)
    filings.write_chunks(c([("3", "t", "A", "10-K", "f", "child")]), path)
    assert sorted(r.chunk_id for r in filings.read_chunks(spark, path).collect()) == ["2", "3"] and filings.seeded(spark, wanted, path).count() == 0
    (tmp_path / "b.jsonl").write_text('{"question":"q","answer":"1","company":"X","evidence":[{"evidence_text":"e"},{}],"doc_name":"n"}\n\n')
    assert filings.read_benchmark(spark, f"{tmp_path}/b.jsonl").first().asDict() == {"question": "q", "ground_truth": "1", "ticker": "X", "filing_type": "", "period": ""}
    assert filings.read_evidence(spark, f"{tmp_path}/b.jsonl").first().evidence == ["e", ""]


def test_search_over_segments_and_health(spark, units, tmp_path):
    path = f"{tmp_path}/ix"
    segments.add(units, path)
    loaded = segments.load(spark, path)
    for question, extra in (("a purchase of equipment", {}), ("data center revenue", {"ticker": "NVDA"}), ("revenue", {"year": 2018})):
        assert search(units, question, loaded=loaded, **extra) == search(units, question, **extra)
    row = tools.health(units, "a purchase of equipment", loaded=loaded).first()
    assert row.ok and row.passages >= 1 and row.error is None
    assert not tools.health(units, "nothing of the kind", loaded=loaded).first().ok
    broken = tools.health(units.drop("text"), "a purchase").first()
    assert not broken.ok and broken.error


def test_companies_to_chunks(spark):
    html = lambda x: f"<html><p>{x} reported revenue of twelve million in the year, and some more words.</p><table><tr><th>item</th><th>2020</th></tr><tr><td>sales</td><td>1,200</td></tr></table></html>"
    subs = spark.createDataFrame([(1, 0, ["10-K", "10-K", "8-K"], ["r"] * 3, ["2021-02-01", "2020-02-01", "2021-03-01"], ["a1", "a2", "a3"], ["d"] * 3), (2, 0, ["10-K"], ["r"], ["2021-02-01"], ["b1"], ["d"])], "cik long, page int, form array<string>, reportDate array<string>, filingDate array<string>, accessionNumber array<string>, primaryDocument array<string>")
    companies = spark.createDataFrame([("AAA",), ("BBB",), ("CCC",), ("DDD",)], "ticker string")
    live = spark.createDataFrame([("aaa", 1), ("BBB", 2)], "ticker string, cik long")
    wanted = ingest.wanted_filings(companies, live, spark.createDataFrame([("DDD", 4)], "ticker string, cik long"), subs)
    docs = spark.createDataFrame([(1, "a1", html("A")), (1, "a2", html("B"))], "cik long, accession string, html string")
    made, errors = ingest.ingested(wanted, docs)
    assert {(r.ticker, r.error) for r in errors.collect()} == {("BBB", "no document"), ("CCC", "unknown company"), ("DDD", "no filings")}
    got = made.collect()
    assert {(r.ticker, r.form, r.filed) for r in got} == {("AAA", "10-K", "2021-02-01"), ("AAA", "10-K", "2020-02-01")}
    assert sorted(r.chunk_type for r in got) == ["child", "child", "parent", "parent", "table", "table"]
    assert {r.text for r in got if r.chunk_type == "table"} == {"item | 2020\nsales | 1200"} and all(len(r.chunk_id) == 32 for r in got)
    docs = docs.filter("accession = 'a1'")
    assert ingest.ingested(wanted, docs)[0].count() == 0  # a company that lacks a document gives nothing


def test_ids_of_differences_can_be_verified(spark):
    rows = [(7, "us-gaap", c, c, "USD", 0, 1, None, "2023-12-31", v, 2023, "FY", "10-K", "2024-02-01", "x") for c, v in (("NetCashProvidedByUsedInOperatingActivities", 7_622_826.0), ("PaymentsToAcquirePropertyPlantAndEquipment", 348_552.0))]
    all_facts = spark.createDataFrame(rows, "cik long, namespace string, concept string, label string, unit string, unit_at int, at int, start string, end string, val double, fy int, fp string, form string, filed string, accn string")
    answer = tools.company_financials(all_facts, {"TST": 7}, ["TST"], ["free cash flow"], "FY2023").first()
    assert answer.id == "derived:7:free cash flow:FY2023" and answer.val == 7_274_274.0
    ids = [answer.id, answer.inputs[0].id, "derived:7:free cash flow:FY2001", "derived:7:no such metric:FY2023", "derived:x"]
    none = spark.createDataFrame([], "key string, text string")
    got = tools.verify_figures("It was $7,274,274 of $7.6 million, not $5 million.", ids, none, facts.values(all_facts), {"TST": 7}).first()
    assert got.grounded == ["$7,274,274", "$7.6 million"] and got.not_found == ["$5 million"]
    assert got.unknown_ids == sorted(ids[2:]) and got.checked_against == 2


def test_sketches_merge_within_their_bound(spark):
    log = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("tool"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id") % 86_400)).alias("ts"), (F.abs(F.hash("id")) % 100_000).cast("double").alias("latency"))
    hours = service.latency_sketches(log)
    assert hours.count() == 48
    for merged in (service.merged_sketches(hours), service.merged_sketches(service.merged_sketches(hours, "day"), "month"), service.merged_sketches(service.latency_sketches(log, "day"))):
        for r in service.sketched_latencies(merged).collect():
            values = [x.latency for x in log.filter(F.col("tool") == r.tool).select("latency").collect()]
            assert r.calls == len(values) and r.worst == max(values)
            for q, at in ((0.5, r.p50), (0.99, r.p99)):
                assert abs(sum(v <= at for v in values) / len(values) - q) < 0.01
    empty = spark.createDataFrame([("t", "2024-01-01 00:00:00", None)], "tool string, ts string, latency double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r.calls, r.p50, r.worst) for r in service.sketched_latencies(service.latency_sketches(empty)).collect()] == [(1, None, None)]


def test_chunking_takes_time_in_proportion(spark):
    took = {}
    for n in (1_000, 100_000, 1_000):
        text = "\n".join(f"block number {i} of a long filing, with ten words in it" for i in range(n))
        df = spark.createDataFrame([(1, "T", "10-K", "2020-01-01", text)], "doc_id int, ticker string, form string, filed string, text string")
        start = time.perf_counter()
        got = chunks.chunks(df).select("nth", "words").collect()
        took[n] = time.perf_counter() - start
        assert sum(r.words for r in got) == 12 * n and all(r.words == 408 for r in got[:-1])
    assert took[100_000] < took[1_000] + 20


def test_table_repair_takes_time_in_proportion_to_the_table(spark):
    """Steps that were computed anew for every cell and mention took the square of a table's size."""
    body = [" | 2020.0 | 2020 |  | 2019 | 2019 | ", *(f"line {i} | $ | {i}.5 |  | $ | {i}.0 | " for i in range(1500))]
    long = spark.range(1).select(F.concat(F.lit("\n".join(["0 | 1 | 2 | 3 | 4 | 5 | 6", *body])), F.col("id").cast("string")).alias("t"))
    began = time.monotonic()
    got = long.select(pages.repaired(F.col("t")).alias("r")).first().r.split("\n")
    assert got == [" | 2020 | 2019", *(f"line {i} | ${i}.5 | ${i}" for i in range(1499)), "line 1499 | $1499.5 | $1499 | 0"] and time.monotonic() - began < 20


def test_pages_are_parsed_one_at_a_time(monkeypatch):
    """The trees of a whole batch of pages were held at once."""
    alive = []

    class Counted(pages._Tree):
        def __init__(self):
            super().__init__()
            Counted.now = getattr(Counted, "now", 0) + 1
            alive.append(Counted.now)

        def __del__(self):
            Counted.now -= 1

    monkeypatch.setattr(pages, "_Tree", Counted)
    html = pa.array(["<p>" + "word " * 12 + "</p><table><tr><td>1<td>2</tr></table>", None] * 300)
    out = list(pages._parts(iter([html, html.slice(0, 0)])))
    assert sum(map(len, out)) == 600 and max(map(len, out)) <= pages.PAGES and max(alive) <= 2
    assert out[0][0].as_py() == {"blocks": [("word " * 12).strip()], "tables": [{"headers": ["0", "1"], "rows": [["1", "2"]]}]}


def test_ids_are_looked_up_in_figures_that_are_made_once(spark):
    """The picks of `values` were made anew for each of their uses."""
    facts_ = spark.createDataFrame([(1, "us-gaap", "A", "a", "USD", 0, 0, None, "1996-12-31", 5.0, 1996, "FY", "10-K", "1997-01-01", "x")], "cik long, namespace string, concept string, label string, unit string, unit_at int, at int, start string, end string, val double, fy int, fp string, form string, filed string, accn string")
    cited = spark.createDataFrame([("xbrl:T:us-gaap:A:FY1996",), ("derived:1:d:FY1996",)], "key string")
    metrics = spark.createDataFrame([("a", "A", 0), ("b", "A", 0)], "metric string, concept string, prio int")
    got = facts.values_of(cited, facts.values(facts_), spark.createDataFrame([("T", 1)], "ticker string, cik long"), metrics, {"d": ("a", "b")})
    assert "min_by" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [("derived:1:d:FY1996", 0.0), ("xbrl:T:us-gaap:A:FY1996", 5.0)]
