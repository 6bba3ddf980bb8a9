"""Column functions on fixtures."""

import time

import pytest
from pyspark.sql import functions as F

from quillstone.functions import figures as G
from quillstone.functions import questions as Q
from quillstone.functions import stem, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("question", "ticker"),
    [("3M capex in 2018", "MMM"), ("How did NVDA do?", "NVDA"), ("What is the F-score?", None), ("its target and ups", None), ("Ford against Tesla", None), ("UPS growth", "UPS"), ("", None)],
)
def test_company(spark, question, ticker):
    assert one(spark, Q.company, question) == ticker


@pytest.mark.parametrize(
    ("question", "years"), [("FY18 results", [2018]), ("FY 2018", [2018]), ("fiscal year 2018", [2018]), ("2023 to 2025", [2023, 2025]), ("paid $1577 and 12,018", []), ("$2019 or 2019.5", [2019])]
)
def test_years(spark, question, years):
    assert one(spark, Q.years, question) == years


@pytest.mark.parametrize(
    ("period", "want"),
    [("FY2023", (2023, "FY")), ("2023", (2023, "FY")), ("fiscal 2023", (2023, "FY")), ("fiscal year 2023", (2023, "FY")), ("FY23", (2023, "FY")), ("Q3 2024", (2024, "Q3")), ("Q3 FY2024", (2024, "Q3")), ("2024 Q3", (2024, "Q3")), ("q3-2024", (2024, "Q3")), ("latest", (None, "FY")), ("", (None, "FY")), (None, (None, "FY"))],
)
def test_period(spark, period, want):
    r = one(spark, Q.period, period)
    assert (r.fy, r.fp) == want and r.ok


def test_period_not_understood(spark):
    assert not one(spark, Q.period, "next spring").ok


@pytest.mark.parametrize(
    ("metric", "name"), [("Capex", "capital expenditure"), ("Long-Term Debt", "long-term debt"), ("debt", "long-term debt"), ("total equity", "total equity"), ("Free cash flow", "free cash flow"), ("us-gaap:AssetsNet", "AssetsNet"), ("PP&E", "property plant and equipment"), ("Revenue", "revenue"), ("odd thing", "odd thing")]
)
def test_metric_names(spark, metric, name):
    assert one(spark, Q.metric_name, metric) == name


def test_metric_names_strict(spark):
    assert one(spark, lambda c: Q.metric_name(c, True), "total equity") == "shareholders equity"
    assert one(spark, lambda c: Q.metric_name(c, True), "debt") == "long-term debt"


def test_cleaning_and_expansion(spark):
    assert one(spark, Q.cleaned, "Assume that you are an analyst. What is X? Round your answer to two places.") == "What is X?"
    assert one(spark, Q.cleaned, "Answer in USD: what is X?") == "what is X?"
    assert one(spark, Q.cleaned, "Round your answer.") == "Round your answer."
    assert one(spark, Q.cleaned, "What is the ratio? If it is not a metric that is useful, say so.") == "What is the ratio?"
    assert one(spark, Q.expanded, "capex of 3M") == "capex of 3M purchases of property plant and equipment PP&E capital spending"
    assert one(spark, Q.expanded, "net sales") == "net sales"
    assert one(spark, Q.ratio_lines, "quick ratio and ROA") == ["cash and cash equivalents", "short-term investments", "accounts receivable", "total current liabilities", "net income", "total assets"]


@pytest.mark.parametrize(("name", "want"), [("X_2018Q2_10Q", (2018, 2, "10-Q")), ("A_B_2018_10K", (2018, None, "10-K")), ("X_2018_8K", (None, None, None))])
def test_document_names(spark, name, want):
    assert tuple(one(spark, Q.document_name, name)) == want


@pytest.mark.parametrize(
    ("figure", "hit"),
    [("$33.7 billion", True), ("$33,700 million", False), ("$33.8 billion", False), ("$33,723.3 million", True), ("$12.03", True), ("$12.04", False), ("12%", False), ("$33,723,297,000", True), ("$33,723", True), ("$33.723B", True)],
)
def test_tolerance(spark, figure, hit):
    values = F.array(F.lit(33_723_297_000.0), F.lit(12.03))
    assert one(spark, lambda c: G.states_any(c, values), figure) is hit


def test_figures(spark):
    assert one(spark, G.figures, "costs $1,234, and 3.5% of 1,234,567 or $5 million; 1234") == ["$1,234", "3.5%", "1,234,567", "$5 million"]
    src = G.source_values(F.lit("$ | (1,577) and 1,234.56"))
    assert one(spark, lambda c: G.grounded(G.figures(c), src), "$1,577 million and $1,234") == ["$1,577 million"]
    assert one(spark, lambda c: G.not_grounded(G.figures(c), src), "$1,577 million and $1,234") == ["$1,234"]


@pytest.mark.parametrize(
    ("value", "unit", "want"),
    [(-1577e6, "USD", "-$1,577.0 million"), (6854.0, "USD", "$6,854"), (12.03, "USD/shares", "$12.03 per share"), (443e6, "shares", "443.0 million shares"), (33_723_297_000.0, "USD", "$33,723.3 million")],
)
def test_display(spark, value, unit, want):
    assert one(spark, lambda c: G.shown(c, F.lit(unit)), value, "double") == want


def test_evaluated(spark):
    assert one(spark, G.evaluated_numbers, "$26.4B and 26,400 million, 5 thousand, 3%") == [26.4e9, 26.4e9, 5.0, 3.0]
    assert one(spark, lambda c: G.states_truth(c, F.lit("$94036.00")), "$94,036 million") is True
    assert one(spark, lambda c: G.states_truth(c, F.lit("none")), "5") is None
    assert one(spark, G.declines, "The text does NOT provide it.") is True


def test_chunks(spark):
    blocks = [" ".join(["w"] * 100)] * 9
    assert [len(c.split()) for c in one(spark, lambda c: text.greedy_chunks(c, 400), blocks, "array<string>")] == [400, 400, 100]
    assert one(spark, lambda c: text.greedy_chunks(c, 400), [], "array<string>") == []
    assert one(spark, text.word_count, "a b  c ") == 3
    assert one(spark, text.passage_text, "x" * 8001).endswith("x [... truncated]")
    assert one(spark, lambda c: text.citation(c, F.lit("10-K"), F.lit("2020-01-01"), F.lit(None).cast("int")), "T") == "[T 10-K 2020-01-01]"
    assert one(spark, lambda c: text.chunk_id(c, F.lit(None)), "a") == one(spark, lambda c: text.chunk_id(c, F.lit("")), "a")


@pytest.mark.parametrize(
    ("word", "want"),
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("purchases", "purchas")],
)
def test_porter(word, want):
    assert stem.porter(word) == want


def test_a_company_is_looked_for_by_its_letters_first(spark):
    """A pattern for each company was tried at every place of a long question."""
    long = spark.range(1).select(F.concat(F.repeat(F.lit("plain words of a filing "), 400_000), F.lit("Apple"), F.col("id").cast("string").substr(2, 1)).alias("q"))
    began = time.monotonic()
    assert long.select(Q.company(F.col("q")).alias("t")).first().t == "AAPL"
    assert time.monotonic() - began < 40
