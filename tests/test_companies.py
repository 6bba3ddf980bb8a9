"""The data source of companies' documents: partitions, retries, errors as rows, streams."""

import json

import pytest
from pyspark.sql import functions as F

from quillstone.sources import companies

SCHEMA = "facts map<string, array<double>>"


@pytest.fixture
def folder(tmp_path):
    for ticker, body in (("AAA", json.dumps({"facts": {"Revenues": [1.0, 2.0]}})), ("BBB", "{ not json"), ("CCC", json.dumps({"facts": {}, "é": 1}))):
        (tmp_path / f"{ticker}.json").write_text(body, encoding="utf-8")
    return str(tmp_path)


def test_a_row_for_every_company(spark, folder):
    got = companies.documents(spark, folder, ["aaa", "BBB", "GONE", "AAA", " "], wait=0)
    rows = {r.ticker: (r.body is not None, r.tries, r.error) for r in got.collect()}
    assert rows == {"AAA": (True, 1, None), "BBB": (True, 1, None), "GONE": (False, 1, "not found")}
    assert got.rdd.getNumPartitions() == 3
    assert companies.documents(spark, folder, []).count() == 0 and companies.documents(spark, f"file://{folder}", ["AAA"]).count() == 1


def test_filters_on_the_ticker_choose_partitions(spark, folder):
    got = companies.documents(spark, folder, ["AAA", "BBB", "CCC", "GONE"])
    assert [r.ticker for r in got.filter("ticker = 'CCC'").collect()] == ["CCC"]
    assert sorted(r.ticker for r in got.filter(F.col("ticker").isin("AAA", "GONE", "ZZZ")).collect()) == ["AAA", "GONE"]
    assert got.filter("ticker = 'CCC'").rdd.getNumPartitions() == 1 and got.filter("ticker = 'ZZZ'").count() == 0
    assert [r.ticker for r in got.filter("error IS NOT NULL").collect()] == ["GONE"]


def test_failures_are_tried_again_with_growing_waits():
    waits, left = [], [OSError("busy"), TimeoutError("slow")]

    def read():
        if left:
            raise left.pop(0)
        return b"ok"

    assert companies.fetched(read, 5, 2.0, waits.append) == (b"ok", 3, None) and waits == [2.0, 4.0]

    def broken():
        raise OSError("down")

    waits.clear()
    assert companies.fetched(broken, 7, 2.0, waits.append) == (None, 7, "OSError: down") and waits == [2.0, 4.0, 8.0, 16.0, 32.0, 60.0]
    with pytest.raises(ValueError):  # what is no failure of the source is no reason to try again
        companies.fetched(lambda: int("x"), 5, 0, waits.append)


def test_errors_are_rows(spark, folder):
    ciks = spark.createDataFrame([("AAA", 1), ("BBB", 2), ("GONE", 3)], "ticker string, cik long")
    docs, errors = companies.company_facts(companies.documents(spark, folder, ["AAA", "BBB", "CCC", "GONE"]), ciks, SCHEMA)
    assert [(r.ticker, r.cik, r.doc.facts) for r in docs.collect()] == [("AAA", 1, {"Revenues": [1.0, 2.0]})]
    assert {r.ticker: r.error for r in errors.collect()} == {"BBB": "not a document of facts", "CCC": "unknown company", "GONE": "not found"}


def test_new_listings_stream(spark, tmp_path):
    companies.register(spark)
    (tmp_path / "in").mkdir()

    def run():
        s = spark.readStream.format("company_listings").option("path", f"{tmp_path}/in").load()
        s.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(120)
        return sorted((r.name, r.body) for r in spark.read.schema("name string, body string").parquet(f"{tmp_path}/out").collect())

    (tmp_path / "in" / "0001.json").write_text("a")
    (tmp_path / "in" / "readme.txt").write_text("no listing")
    assert run() == [("0001.json", "a")]
    (tmp_path / "in" / "0002.json").write_text("b")
    (tmp_path / "in" / "0003.json").write_text("c")
    assert run() == [("0001.json", "a"), ("0002.json", "b"), ("0003.json", "c")] == run()
