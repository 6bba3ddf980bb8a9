"""Streaming operators equal their batch forms."""

import shutil
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quillstone.operators import corpus
from quillstone.operators import service as batch
from quillstone.sources import manifests
from quillstone.streaming import service

EVENTS = "/root/testdata/sf0.001/events.parquet"


def drained(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def stream(spark, tmp_path, ts="ts"):
    spark.read.parquet(EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    s = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    return service.event_time(s.select(F.col("event_id").alias("id"), F.expr(ts).alias("ts"), F.col("event_type").alias("tool"), "value"))


def test_counts_of_closed_windows(spark, tmp_path):
    got = drained(spark, service.call_counts(stream(spark, tmp_path), "1 day"), "counts")
    want = spark.read.parquet(EVENTS).groupBy(F.date_trunc("day", "ts").cast("timestamp").alias("d"), F.col("event_type").alias("tool")).agg(F.count("*").alias("calls"))
    got = {(r.d, r.tool): r.calls for r in got.select(F.col("w.start").alias("d"), "tool", "calls").collect()}
    want = {(r.d, r.tool): r.calls for r in want.collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 5


def shuffled(spark, tmp_path, rows, schema, parts=5, seed=3):
    """A stream of the rows in any order over micro-batches, ended by a row that lets the watermark pass them all."""
    order = np.random.default_rng(seed).permutation(len(rows))
    for n in range(parts):
        time.sleep(0.02)  # files are taken in order of their times
        spark.createDataFrame([rows[i] for i in order[n::parts]], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    last = dict(zip(spark.createDataFrame([], schema).columns, rows[0], strict=True)) | {"id": -1, "ts": max(r[1] for r in rows) + timedelta(days=60)}
    spark.createDataFrame([tuple(last.values())], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{parts}")
    s = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    return service.event_time(s, "3 days")


def calls_of_a_day(n=400):
    """Calls in bursts, several at one instant, some at the last moment of the day, and a few on the day after."""
    r, day = np.random.default_rng(4), datetime(2024, 3, 1)
    return [(i, day + timedelta(minutes=int(r.integers(0, 40)) * (37 if i % 9 else 36), seconds=int(r.integers(0, 3)) * 29.999999), f"t{i % 3}", f" Arg {'ab'[i % 2]}  {i % 4}", i % 5 != 0) for i in range(n)]


CALLS = "id long, ts timestamp, tool string, arguments string, clean boolean"


@pytest.mark.parametrize("seed", [1, 2])
def test_limits_of_shuffled_calls_equal_batch(spark, tmp_path, seed):
    rows = calls_of_a_day()
    got = drained(spark, service.limited(shuffled(spark, tmp_path, rows, CALLS, seed=seed), 7, 180), f"limits{seed}")
    want = batch.call_limits(spark.createDataFrame(rows, CALLS), 7, 180).collect()
    assert {(r.id, r.allowed, r.reason, r.retry_after) for r in got.filter("id >= 0").collect()} == {(r.id, r.allowed, r.reason, r.retry_after) for r in want}
    assert {r.reason for r in want} == {None, "minute", "day"} and got.filter("id >= 0").count() == len(rows)


def test_budget_of_shuffled_requests_equals_batch(spark, tmp_path):
    rows = [(i, ts, i * 7 % 50 if i % 11 else None) for i, ts, *_ in calls_of_a_day()]
    schema = "id long, ts timestamp, tokens long"
    got = drained(spark, service.budgeted(shuffled(spark, tmp_path, rows, schema), 3000), "budget")
    want = {r.id: r.granted for r in batch.budget(spark.createDataFrame(rows, schema), 3000).collect()}
    assert {r.id: r.granted for r in got.filter("id >= 0").collect()} == want and len(set(want.values())) == 2


def test_cache_of_shuffled_calls_equals_batch(spark, tmp_path):
    rows = [(i, ts, f"k{i % 7}" if i % 10 else None, clean) for i, ts, _, _, clean in calls_of_a_day()]
    schema = "id long, ts timestamp, key string, clean boolean"
    got = drained(spark, service.cached(shuffled(spark, tmp_path, rows, schema), 6), "cache")
    want = {r.id: r.hit for r in batch.cache_hits(spark.createDataFrame(rows, schema), 6).collect()}
    assert {r.id: r.hit for r in got.filter("id >= 0").collect()} == want and len(set(want.values())) == 2


def test_guard_of_shuffled_calls_equals_batch(spark, tmp_path):
    rows = calls_of_a_day(240)
    got = drained(spark, service.guarded(shuffled(spark, tmp_path, rows, CALLS, 3), "v1", 5, 90, 3), "guard").filter("id >= 0").collect()
    want = batch.guarded(spark.createDataFrame(rows, CALLS), "v1", 5, 90, 3).collect()
    key = lambda r: (r.id, r.tool, r.arguments, r.clean, r.rate_limited, r.reason, r.retry_after, r.cache_hit, r.worked)
    assert sorted(map(key, got), key=str) == sorted(map(key, want), key=str)
    assert {(r.rate_limited, r.cache_hit) for r in want} == {(True, False), (False, True), (False, False)}


def test_what_the_watermark_has_not_passed_waits(spark, tmp_path):
    rows = [(1, datetime(2024, 3, 1, 1), 5), (2, datetime(2024, 3, 3), 5), (3, datetime(2024, 3, 5), 5)]
    spark.createDataFrame(rows, "id long, ts timestamp, tokens long").coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("id long, ts timestamp, tokens long").parquet(f"{tmp_path}/in")
    got = drained(spark, service.budgeted(service.event_time(s, "3 days"), 8), "waiting")
    assert [r.id for r in got.collect()] == [1]


def test_first_of_each(spark, tmp_path):
    s = stream(spark, tmp_path).withColumn("key", F.concat_ws("|", "tool", F.date_format("ts", "yyyy-MM-dd")))
    got = drained(spark, service.first_of_each(s), "firsts")
    assert got.count() == got.select("key").distinct().count()


LISTED = "ticker string, form string, filed string, text string, ok boolean"


def test_refresh(spark, tmp_path):
    put = lambda n, rows: spark.createDataFrame(rows, LISTED).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    path = f"{tmp_path}/corpus"

    def run(build=lambda f: f.withColumn("chunk_id", F.md5("text"))):
        s = spark.readStream.schema(LISTED).parquet(f"{tmp_path}/in/*")
        service.refresh(s, path, build, f"{tmp_path}/check").awaitTermination(120)
        return sorted((r.ticker, r.filed) for r in corpus.read(spark, path).collect())

    put(1, [("A", "10-K", "2020-01-01", "a", True), ("B", "10-K", "2020-01-01", "b", True), ("B", "10-Q", "2020-05-01", "c", False)])
    assert run() == [("A", "2020-01-01")]
    time.sleep(1.1)
    put(2, [("A", "10-Q", "2020-01-01", "same day", True), ("A", "10-Q", "2020-05-01", "new", True), ("B", "10-K", "2020-01-01", "b", True)])

    def breaks(f):
        raise RuntimeError("between write and commit")

    with pytest.raises(StreamingQueryException):
        run(breaks)
    assert sorted((r.ticker, r.filed) for r in corpus.read(spark, path).collect()) == [("A", "2020-01-01")]
    assert run() == [("A", "2020-01-01"), ("A", "2020-05-01"), ("B", "2020-01-01")]  # the batch is tried again
    assert manifests.versions(spark, path) == [1, 2] and run() == [("A", "2020-01-01"), ("A", "2020-05-01"), ("B", "2020-01-01")]


def test_corpus_is_published_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path, build = f"{tmp_path}/corpus", lambda f: f.withColumn("chunk_id", F.md5("text"))
    rows = lambda *r: spark.createDataFrame([(*x, "text", True) for x in r], LISTED)
    held = lambda: sorted((r.ticker, r.form, r.filed) for r in corpus.read(spark, path).collect())
    a, b, c, d = ("A", "10-K", "2020-01-01"), ("B", "10-K", "2020-01-01"), ("C", "10-Q", "2021-01-01"), ("D", "10-Q", "2021-01-01")
    assert corpus.read(spark, path) is None and corpus.add(rows().limit(0), path, build) is None
    assert corpus.add(rows(a, b), path, build, "s", 0) == 1 and held() == [a, b]
    assert corpus.add(rows(a, b), path, build, "s", 7) is None  # nothing changes, nothing is written
    assert corpus.add(rows(c), path, build, "s", 0) is None  # a batch that was taken
    with pytest.raises(ValueError):  # chunks of a filing that came are missing
        corpus.add(rows(c, d), path, lambda f: build(f.filter("ticker <> 'D'")), "s", 1)
    assert held() == [a, b] and manifests.versions(spark, path) == [1]

    def broken(*args):
        raise OSError("the run breaks off before the manifest is written")

    with monkeypatch.context() as m:
        m.setattr(manifests, "commit", broken)
        with pytest.raises(OSError):
            corpus.add(rows(c), path, build, "s", 1)
    assert held() == [a, b]
    assert corpus.add(rows(c), path, build, "s", 1) == 2 and held() == [a, b, c]
    assert corpus.compact(spark, path) == 3 and held() == [a, b, c] and corpus.compact(spark, path) is None
    assert corpus.add(rows(d), path, build, "s", 0) is None and corpus.add(rows(d), path, build, "s", 2) == 4
    assert sorted((r.ticker, r.chunks) for r in corpus.coverage(spark, path).collect()) == [("A", 1), ("B", 1), ("C", 1), ("D", 1)]
    assert sorted(r.ticker for r in corpus.read(spark, path, 1).collect()) == ["A", "B"]
    assert any(x.startswith("parts/") for x in corpus.forget(spark, path)) and held() == [a, b, c, d] and corpus.forget(spark, path) == []
    assert manifests.versions(spark, path) == [4] and corpus.read(spark, path, 1) is None
    lost = [x for x in (tmp_path / "corpus" / "parts").glob("*/ticker=A")]
    shutil.rmtree(lost[0])
    with pytest.raises(ValueError):  # what is held lacks a filing that was covered
        corpus.add(rows(("E", "10-K", "2022-01-01")), path, build, "s", 3)


def test_log_is_appended(spark, tmp_path):
    calls = "ts timestamp, tool string, arguments string, latency_ms int, passages array<struct<ticker:string>>, figures map<string,array<double>>, cache_hit boolean, rate_limited boolean, error string"
    spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:00' AS ts, 't' AS tool, 'x' AS arguments, 5 AS latency_ms, array(struct('A' AS ticker)) AS passages, map('B', array(1D)) AS figures, false AS cache_hit, false AS rate_limited, 'e' AS error").write.parquet(f"{tmp_path}/calls")
    for _ in range(2):  # what was logged is not logged again
        service.logged(spark.readStream.schema(calls).parquet(f"{tmp_path}/calls"), f"{tmp_path}/log", f"{tmp_path}/check").awaitTermination(120)
    assert [(r.n_passages, r.n_figures, r.tickers) for r in batch.live_log(spark, f"{tmp_path}/log", "2024-02-01 00:00:00").collect()] == [(1, 1, ["A", "B"])]
