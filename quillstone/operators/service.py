"""Service data: call limits, token budget, result cache, call log, refresh, choice of filings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.functions.reference import CACHE_HOURS, CALLS_A_DAY, CALLS_A_MINUTE, LOG_DAYS, LOGGED_CHARS, TOKENS_A_DAY


def call_limits(calls: DataFrame, a_minute: int = CALLS_A_MINUTE, a_day: int = CALLS_A_DAY) -> DataFrame:
    """calls (id, ts) with allowed, reason and retry_after, by the order of (ts, id).

    The minute is counted first: a call that the day turns away has used up one of its minute. So the n-th call
    of a minute passes it if n is within the limit, and the day counts only such calls.
    """
    minute, day = F.date_trunc("minute", "ts"), F.date_trunc("day", "ts")
    order = ["ts", "id"]
    c = calls.withColumn("_m", minute).withColumn("_d", day).withColumn("_nm", F.row_number().over(W.partitionBy("_m").orderBy(*order)))
    # the calls that passed their minute before this one: those of earlier minutes, summed by minute, and this minute's
    sums = c.groupBy("_d", "_m").agg(F.least(F.count("*"), F.lit(a_minute)).alias("_k"))
    before = F.coalesce(F.sum("_k").over(W.partitionBy("_d").orderBy("_m").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    c = c.join(sums.withColumn("_before", before).drop("_d", "_k"), "_m")
    in_minute = F.col("_nm") <= a_minute
    in_day = F.col("_before") + F.col("_nm") <= a_day
    left = lambda start, seconds: F.greatest(F.lit(1), (F.unix_seconds(start.cast("timestamp")) + seconds - F.unix_seconds(F.col("ts").cast("timestamp"))).cast("int"))
    reason = F.when(~in_minute, "minute").when(~in_day, "day")
    retry = F.when(~in_minute, left(F.col("_m"), 60)).when(~in_day, left(F.col("_d"), 86400))
    return c.select("id", "ts", (in_minute & in_day).alias("allowed"), reason.alias("reason"), retry.alias("retry_after"))


def _walked(rows: DataFrame, key: str, order: list[str], walk: Callable, schema: str) -> DataFrame:
    """Walk through each key's rows in order, holding only what the walk itself keeps of one key.

    A key's rows are dealt to one task, since each step depends on those before, but they stream through it.
    """
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(walk, schema)


def budget(requests: DataFrame, cap: int = TOKENS_A_DAY) -> DataFrame:
    """requests (id, ts, tokens): granted while a day's granted tokens stay within the cap, in order of (ts, id).

    A rejected request does not count, so this is a walk through each day and not a running sum.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        day, used = None, 0
        for f in frames:
            granted, after = [], []
            for d, tokens in zip(f["day"], f["tokens"], strict=True):
                day, used = (day, used) if d == day else (d, 0)
                granted.append(used + tokens <= cap)
                used += tokens if granted[-1] else 0
                after.append(used)
            yield pd.DataFrame({"day": f["day"], "id": f["id"], "tokens": f["tokens"], "granted": granted, "used": after})

    rows = requests.select(F.date_trunc("day", "ts").alias("day"), "ts", "id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return _walked(rows, "day", ["ts", "id"], walk, f"day {kinds['day']}, id {kinds['id']}, tokens long, granted boolean, used long")


def cache_key(tool: Column, arguments: Column, version: str) -> Column:
    """A digest that folds case and spacing of the arguments."""
    text = F.concat_ws("|", F.lit(version), tool, F.trim(F.regexp_replace(F.lower(arguments), r"\s+", " ")))
    return F.sha2(text, 256)


def cache_hits(calls: DataFrame, hours: int = CACHE_HOURS) -> DataFrame:
    """calls (id, ts, key, clean): a hit if the newest stored result of the key is younger than the bound.

    Only clean results are stored, and only by calls that were no hits; those form a chain in each key.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, stored = None, None
        for f in frames:
            hits = []
            for k, now, clean in zip(f["key"], f["at"], f["clean"], strict=True):
                key, stored = (key, stored) if k == key else (k, None)
                hits.append(stored is not None and now - stored < hours * 3600)
                stored = now if clean and not hits[-1] else stored
            yield pd.DataFrame({"key": f["key"], "id": f["id"], "hit": hits})

    rows = calls.select("key", "ts", "id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.coalesce("clean", F.lit(False)).alias("clean"))
    return _walked(rows, "key", ["ts", "id"], walk, f"key string, id {calls.schema['id'].dataType.simpleString()}, hit boolean")


def guarded(calls: DataFrame, version: str, a_minute: int = CALLS_A_MINUTE, a_day: int = CALLS_A_DAY, hours: int = CACHE_HOURS) -> DataFrame:
    """calls (id, ts, tool, arguments, clean): the shared limits first, then the cache, then the work itself.

    Adds rate_limited, reason, retry_after, cache_hit and worked. A call that is turned away asks no cache and
    stores nothing.
    """
    limits = call_limits(calls.select("id", "ts"), a_minute, a_day).drop("ts")
    passed = calls.join(limits.filter("allowed").select("id"), "id").withColumn("key", cache_key(F.col("tool"), F.col("arguments"), version))
    hits = cache_hits(passed.select("id", "ts", "key", "clean"), hours).select("id", "hit")
    out = calls.join(limits, "id").join(hits, "id", "left").withColumn("cache_hit", F.coalesce("hit", F.lit(False)))
    return out.select(*calls.columns, (~F.col("allowed")).alias("rate_limited"), "reason", "retry_after", "cache_hit", (F.col("allowed") & ~F.col("cache_hit")).alias("worked"))


def log_records(calls: DataFrame) -> DataFrame:
    """One record for each call: tool, arguments, latency_ms, passages and figures counted, tickers, outcome, expiry.

    calls: ts, tool, arguments, latency_ms, passages (array of structs with ticker), figures (ticker -> array of
    figures), cache_hit, rate_limited, error. Null results count as empty.
    """
    none = F.array().cast("array<string>")
    named = F.coalesce(F.transform("passages", lambda p: p["ticker"]), none)
    with_figures = F.coalesce(F.map_keys(F.map_filter("figures", lambda k, v: F.size(v) > 0)), none)
    counts = F.coalesce(F.aggregate(F.map_values("figures"), F.lit(0), lambda n, v: n + F.greatest(F.size(v), F.lit(0))), F.lit(0))
    return calls.select(
        "ts", "tool", F.substring("arguments", 1, LOGGED_CHARS).alias("arguments"), "latency_ms", F.coalesce(F.greatest(F.size("passages"), F.lit(0)), F.lit(0)).alias("n_passages"), counts.alias("n_figures"),
        F.sort_array(F.array_distinct(F.filter(F.concat(named, with_figures), lambda t: t.isNotNull() & (t != "")))).alias("tickers"),
        "cache_hit", "rate_limited", "error", (F.col("ts") + F.expr(f"INTERVAL {LOG_DAYS} DAYS")).alias("expires_at"),
    )


def append_log(records: DataFrame, path: str) -> None:
    """Add records to the log, a folder a day, so that what has expired can go by folder."""
    records.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def live_log(spark: SparkSession, path: str, now: str) -> DataFrame:
    """The records that have not expired at this time; expired days are not read."""
    log = spark.read.parquet(path).filter(F.col("day") >= F.date_sub(F.to_date(F.lit(now)), LOG_DAYS))
    return log.filter(F.col("expires_at") > F.lit(now).cast("timestamp")).drop("day")


def hourly_cost(log: DataFrame, gigabytes: float, price: float) -> DataFrame:
    """hour, calls and cost: the seconds that calls took, times memory, times the price of a gigabyte second. log: ts, latency (ms)."""
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss")
    return log.groupBy(hour.alias("hour")).agg(F.count("*").alias("calls"), F.round(F.sum("latency") / 1000 * gigabytes * price, 9).alias("cost"))


def registry(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """A keyed table brought up to date: new values where there are any, else the old ones."""
    names = [c for c in old.columns if c != key]
    fresh = new.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in names if c in new.columns))
    out = old.join(fresh, F.col(key) == F.col("_key"), "full")
    return out.select(F.coalesce(key, "_key").alias(key), *(F.coalesce(f"_{c}", c).alias(c) if c in new.columns else F.col(c) for c in names))


def pending(items: DataFrame, done: DataFrame, key: str = "question") -> DataFrame:
    """The items that a run which was broken off has still to do."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def resumed(items: DataFrame, done: DataFrame, key: str = "question", order: str = "at") -> DataFrame:
    """Every item in its order with what was saved for it; what is not done yet is null. Of several results the first counts."""
    first = done.dropDuplicates([key])
    return items.join(first, key, "left").orderBy(order)


def call_windows(log: DataFrame, minutes: int = 15, least: int = 3) -> DataFrame:
    """Calls and errors of each tool by window, and whether the errors raise an alarm."""
    at = F.window(F.col("ts").cast("timestamp"), f"{minutes} minutes")
    out = log.groupBy(at.alias("w"), "tool").agg(F.count("*").alias("calls"), F.count_if("error").alias("errors"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "tool", "calls", "errors", (F.col("errors") >= least).alias("alarm"))


def latencies(log: DataFrame) -> DataFrame:
    return log.groupBy("tool").agg(F.count("*").alias("calls"), F.round(F.percentile("latency", 0.5), 6).alias("p50"), F.round(F.percentile("latency", 0.99), 6).alias("p99"), F.round(F.max("latency"), 6).alias("worst"))


#: Values that a sketch keeps on its lowest level: its quantiles are within about 0.4 % in rank.
SKETCH_SIZE = 800


def latency_sketches(log: DataFrame, unit: str = "hour") -> DataFrame:
    """tool, start, calls, worst and a quantile sketch of the latencies of each hour: small rows that can be kept and merged.

    log: tool, ts, latency. Null latencies count as calls only.
    """
    latency = F.col("latency").cast("double")
    return log.groupBy("tool", F.date_trunc(unit, "ts").alias("start")).agg(F.count("*").alias("calls"), F.max(latency).alias("worst"), F.kll_sketch_agg_double(latency, F.lit(SKETCH_SIZE)).alias("sketch"))


def merged_sketches(sketches: DataFrame, unit: str = "day") -> DataFrame:
    """The same of longer spans, from the sketches alone; merging in steps or at once keeps the same bound."""
    return sketches.groupBy("tool", F.date_trunc(unit, "start").alias("start")).agg(F.sum("calls").alias("calls"), F.max("worst").alias("worst"), F.kll_merge_agg_double("sketch", F.lit(SKETCH_SIZE)).alias("sketch"))


def sketched_latencies(sketches: DataFrame) -> DataFrame:
    """tool, start, calls, p50, p99 and worst: as `latencies`, whose values are exact, but without a sort of all calls.

    The quantiles are within SKETCH_SIZE's bound in rank; calls and worst are exact.
    """
    at = lambda q: F.when(F.col("worst").isNotNull(), F.kll_sketch_get_quantile_double("sketch", F.lit(q)))
    return sketches.select("tool", "start", "calls", at(0.5).alias("p50"), at(0.99).alias("p99"), "worst")


def new_filings(listed: DataFrame, held: DataFrame) -> DataFrame:
    """Listed filings (ticker, form, filed) on dates that the ticker does not hold; as published, by date only."""
    return listed.join(held.select("ticker", "filed").distinct(), ["ticker", "filed"], "left_anti")


def publishable(before: DataFrame, after: DataFrame) -> DataFrame:
    """Filings that a new corpus lacks; it may be published only if there are none."""
    return before.select("ticker", "form", "filed").distinct().join(after, ["ticker", "form", "filed"], "left_anti")


def chosen_filings(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """The first listed row of each wanted (wid, ticker, year, quarter or null, form), by report date."""
    w, r = wanted.alias("w"), listed.alias("r")
    same = (F.col("w.ticker") == F.col("r.ticker")) & (F.col("w.form") == F.col("r.form")) & (F.col("w.year") == F.year("r.report_date"))
    same = same & (F.col("w.quarter").isNull() | (F.col("w.quarter") == F.quarter("r.report_date")))
    first = F.row_number().over(W.partitionBy("wid").orderBy("at"))
    return w.join(r, same).select("w.wid", "w.ticker", "w.form", "r.report_date", "r.filed", "r.at").withColumn("_n", first).filter("_n = 1").drop("_n")


def latest_filing(listed: DataFrame, cover: DataFrame) -> DataFrame:
    """The newest listed filing of each ticker and form, and whether the corpus covers it."""
    first = F.row_number().over(W.partitionBy("ticker", "form").orderBy(F.desc("filed"), "at"))
    newest = listed.withColumn("_n", first).filter("_n = 1").select("ticker", "form", "filed")
    have = cover.select("ticker", "form", "filed").distinct().withColumn("_c", F.lit(True))
    return newest.join(have, ["ticker", "form", "filed"], "left").withColumn("covered", F.coalesce("_c", F.lit(False))).drop("_c")
