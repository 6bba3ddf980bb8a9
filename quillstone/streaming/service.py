"""The service's stateful operators over Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone.functions.reference import CACHE_HOURS, CALLS_A_DAY, CALLS_A_MINUTE, TOKENS_A_DAY
from quillstone.operators import corpus
from quillstone.operators import service as batch
from quillstone.streaming.ordered import walked


def event_time(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The stream with ts as an instant and a watermark; a wall-clock ts is read in the session's zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def call_counts(calls: DataFrame, width: str = "1 hour") -> DataFrame:
    """Calls and summed values of each tool in windows; a window is emitted once it is closed."""
    return calls.groupBy(F.window("ts", width).alias("w"), "tool").agg(F.count("*").alias("calls"), F.sum("value").alias("value"))


def first_of_each(calls: DataFrame) -> DataFrame:
    """Calls whose key was not seen within the watermark: those that a cache would not answer."""
    return calls.dropDuplicatesWithinWatermark(["key"])


def _two_days_on(kept: int | None, last: int) -> int:
    return last + 2 * 86_400


def budgeted(requests: DataFrame, cap: int = TOKENS_A_DAY) -> DataFrame:
    """requests (id, ts, tokens) with a watermark on ts: day, and granted while the day's granted tokens stay within the cap.

    Decided in the order of (ts, id); see `ordered`. The state of a day is what it has used.
    """

    def step(used: int | None, row: dict) -> tuple[int, tuple]:
        granted = (used or 0) + row["tokens"] <= cap
        return (used or 0) + (row["tokens"] if granted else 0), (granted,)

    rows = requests.select("id", "ts", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return walked(rows, ["day"], step, "granted boolean", _two_days_on).select("ts", "id", "day", "tokens", "granted")


def _counted(rows: DataFrame, unit: str, name: str, most: int, refused: Column) -> DataFrame:
    """Add name: whether a row is among the first `most` of its minute or day, of those not refused before.

    Rows refused before are passed on in lanes of their own, so that only the others, of which a minute lets few
    through, meet in the state of a whole day.
    """

    def step(count: int | None, row: dict) -> tuple[int, tuple]:
        if row["lane"]:
            return count or 0, (False,)
        passed = (count or 0) < most
        return (count or 0) + passed, (passed,)

    lane = F.when(refused, F.pmod(F.xxhash64("id"), F.lit(64)).cast("int") + 1).otherwise(0)
    made = rows.withColumns({"unit": F.date_trunc(unit, "ts"), "lane": lane})
    return walked(made, ["unit", "lane"], step, f"{name} boolean", _two_days_on).drop("unit", "lane")


def limited(calls: DataFrame, a_minute: int = CALLS_A_MINUTE, a_day: int = CALLS_A_DAY) -> DataFrame:
    """calls (id, ts, ...) with a watermark on ts: allowed, reason and retry_after as in the batch form.

    The minute counts first, and the day only what passes it: two walks, one over minutes and one over days.
    """
    minutes = _counted(calls, "minute", "in_minute", a_minute, F.lit(False))
    days = _counted(minutes, "day", "in_day", a_day, ~F.col("in_minute"))
    left = lambda unit, seconds: F.greatest(F.lit(1), (F.unix_seconds(F.date_trunc(unit, "ts")) + seconds - F.unix_seconds("ts")).cast("int"))
    return days.select(
        "ts", *(c for c in calls.columns if c != "ts"), (F.col("in_minute") & F.col("in_day")).alias("allowed"),
        F.when(~F.col("in_minute"), "minute").when(~F.col("in_day"), "day").alias("reason"),
        F.when(~F.col("in_minute"), left("minute", 60)).when(~F.col("in_day"), left("day", 86_400)).alias("retry_after"),
    )


def cached(calls: DataFrame, hours: int = CACHE_HOURS, asks: str | None = None) -> DataFrame:
    """calls (id, ts, key, clean, ...) with a watermark on ts: a hit if the newest stored result of the key is younger than the bound.

    The state of a key is when its result was stored; it goes once that has expired. Only clean results are stored.
    asks: a boolean column; rows where it is false ask and store nothing.
    """

    def step(stored: int | None, row: dict) -> tuple[int | None, tuple]:
        if not row["asks_it"]:
            return stored, (False,)
        now = row["at"] // 1_000_000
        hit = stored is not None and now - stored < hours * 3600
        return (now if row["clean"] and not hit else stored), (hit,)

    def until(stored: int | None, last: int) -> int:
        return (last if stored is None else stored) + hours * 3600

    wanted = F.lit(True) if asks is None else F.col(asks)
    # rows that do not ask are dealt out, so that a key with many of them is no larger for it
    lane = F.when(~wanted, F.pmod(F.xxhash64("id"), F.lit(64)).cast("int") + 1).otherwise(0)
    made = calls.withColumns({"clean": F.coalesce("clean", F.lit(False)), "asks_it": wanted, "lane": lane})
    return walked(made, ["key", "lane"], step, "hit boolean", until).drop("asks_it", "lane")


def guarded(calls: DataFrame, version: str, a_minute: int = CALLS_A_MINUTE, a_day: int = CALLS_A_DAY, hours: int = CACHE_HOURS) -> DataFrame:
    """calls (id, ts, tool, arguments, clean) with a watermark on ts: limits, then the cache, then the work.

    Adds rate_limited, reason, retry_after, cache_hit and worked to every call, those refused included, so that
    all of them can be logged. Three walks, each of which passes on the watermark.
    """
    limits = limited(calls, a_minute, a_day).withColumn("key", batch.cache_key(F.col("tool"), F.col("arguments"), version))
    out = cached(limits, hours, "allowed")
    return out.select(*calls.columns, (~F.col("allowed")).alias("rate_limited"), "reason", "retry_after", F.col("hit").alias("cache_hit"), (F.col("allowed") & ~F.col("hit")).alias("worked"))


def logged(calls: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a record for each call to the log as it comes; see the batch form's `log_records`."""
    records = batch.log_records(calls).withColumn("day", F.to_date("ts"))
    return records.writeStream.partitionBy("day").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def refresh(listed: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Publish newly listed filings (ticker, form, filed, text, ok) as they come, a version for each batch that changes anything.

    See `corpus.add`: a batch is known by the checkpoint and its number, so a replay adds nothing, and a run that
    breaks between the writing of chunks and the commit leaves the former version to readers.
    """

    def apply(rows: DataFrame, number: int) -> None:
        corpus.add(rows, path, build, checkpoint, number)

    return listed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
