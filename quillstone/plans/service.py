"""Queries over the service's own data: limits, budget, cache, call log."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import service, vectors
from quillstone.sources.filings import table


def _calls(spark, d):
    """events as calls: the type is the tool, the value its cost."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("tool"), "user_id", "value", "props")


def q30_rate_limit(spark, d):
    """Limits small enough to bind on these events."""
    out = service.call_limits(_calls(spark, d).select("id", F.date_trunc("hour", "ts").alias("ts")), 2, 12)
    return out.select("id", "allowed", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("retry_after", F.lit(0)).alias("retry_after"))


def q31_budget(spark, d):
    req = _calls(spark, d).select("id", "ts", F.floor("value").cast("long").alias("tokens"))
    return service.budget(req, 500).select("id", "tokens", "granted", "used")


def q32_cache_hits(spark, d):
    key = service.cache_key(F.col("tool"), F.concat(F.lit("  User "), (F.col("user_id") % 20).cast("string")), "v1")
    calls = _calls(spark, d).select("id", "ts", key.alias("key"), (F.col("id") % 4 != 0).alias("clean"))
    return service.cache_hits(calls).select("id", "hit")


def _log(spark, d):
    return _calls(spark, d).select("tool", "ts", F.col("value").alias("latency"), (F.col("value") > 60).alias("error"))


def q33_call_log_windows(spark, d):
    return service.call_windows(_log(spark, d), 240, 1)


def q34_latency_percentiles(spark, d):
    return service.latencies(_log(spark, d))


def q65_latency_sketches(spark, d):
    """Sketches of hours merged into days, and whether their quantiles are within a hundredth, in rank, of the exact ones."""
    log = _log(spark, d)
    days = service.sketched_latencies(service.merged_sketches(service.latency_sketches(log), "month"))
    rows = log.select("tool", F.date_trunc("month", "ts").alias("start"), "latency").join(days, ["tool", "start"])
    share = lambda q, below: F.count(F.when(F.col("latency") < F.col(q) if below else F.col("latency") <= F.col(q), 1)) / F.count("*")
    near = lambda q, at: (share(q, True) <= at + 0.01) & (share(q, False) >= at - 0.01)
    out = rows.groupBy("tool", "start").agg(F.first("calls").alias("calls"), F.round(F.first("worst"), 6).alias("worst"), near("p50", 0.5).alias("p50_near"), near("p99", 0.99).alias("p99_near"))
    return out.select("tool", F.date_format("start", "yyyy-MM-dd").alias("month"), "calls", "worst", "p50_near", "p99_near")


def q55_hourly_cost(spark, d):
    return service.hourly_cost(_log(spark, d), 2.0, 0.0000133334)


def q56_log_records(spark, d):
    """Calls whose results have passages and figures of several companies."""
    c = _calls(spark, d)
    passages = F.transform(F.slice(F.sequence(F.lit(1), F.lit(3)), F.lit(1), (F.col("user_id") % 4).cast("int")), lambda i: F.struct(F.concat(F.lit("T"), ((F.col("user_id") + i) % 3).cast("string")).alias("ticker")))
    figures = F.create_map(F.concat(F.lit("F"), (F.col("user_id") % 2).cast("string")), F.array_repeat(F.col("value"), (F.col("id") % 3).cast("int")))
    calls = c.select("ts", "tool", F.col("id").cast("string").alias("arguments"), F.col("value").alias("latency_ms"), passages.alias("passages"), figures.alias("figures"), F.lit(False).alias("cache_hit"), F.lit(False).alias("rate_limited"), F.lit(None).cast("string").alias("error"))
    return service.log_records(calls).select("arguments", "n_passages", "n_figures", F.array_join("tickers", ",").alias("tickers"), F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


def q58_request_packing(spark, d):
    """Small requests, in the order of each source's documents."""
    return vectors.packed(table(spark, d, "documents").select("doc_id", "source", "text"), "source", "doc_id", 3000, 5).select("doc_id", "tokens", "request")


def q59_registry(spark, d):
    """The largest order of two customers in three, brought up to date with the smallest of every second one."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_totalprice").alias("most"), F.min("o_totalprice").alias("least"))
    old = o.filter("key % 3 <> 0").select("key", F.col("most").alias("value"), F.lit("old").alias("file"))
    out = service.registry(old, o.filter("key % 2 = 0").select("key", F.col("least").alias("value")))
    return out.select("key", F.round("value", 2).alias("value"), F.coalesce("file", F.lit("")).alias("file"))


def q61_vector_records(spark, d):
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "n_chars")
    made = vectors.records(chunks, table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")))
    m = F.col("metadata")
    return made.select("id", F.size("values").alias("width"), F.length(m["text"]).alias("chars"), m["lang"].alias("lang"), m["n_chars"].cast("long").alias("n_chars"))


QUERIES = {name: f for name, f in list(globals().items()) if name[0] == "q" and name[1:3].isdigit()}

ORACLES = {
    "q55_hourly_cost": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS calls, round(sum(value) / 1000 * 2.0 * 0.0000133334, 9) AS cost FROM events GROUP BY 1""",
    "q56_log_records": """SELECT CAST(event_id AS VARCHAR) AS arguments, CAST(user_id % 4 AS INTEGER) AS n_passages, CAST(event_id % 3 AS INTEGER) AS n_figures,
        array_to_string(list_sort(list_distinct(list_concat(list_transform(range(1, user_id % 4 + 1), lambda i: 'T' || ((user_id + i) % 3)), CASE WHEN event_id % 3 > 0 THEN ['F' || (user_id % 2)] ELSE [] END))), ',') AS tickers,
        strftime(ts + INTERVAL 90 DAY, '%Y-%m-%d %H:%M:%S') AS expires_at FROM events""",
    "q58_request_packing": """WITH RECURSIVE c AS (SELECT source, doc_id, CAST(length(substr(coalesce(text, ''), 1, 6000)) // 2 + 1 AS INTEGER) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
        r AS (SELECT source, n, doc_id, tokens, CAST(0 AS BIGINT) AS request, tokens AS used, 1 AS held FROM c WHERE n = 1
              UNION ALL SELECT c.source, c.n, c.doc_id, c.tokens, CASE WHEN r.used + c.tokens > 3000 OR r.held >= 5 THEN r.request + 1 ELSE r.request END,
              CASE WHEN r.used + c.tokens > 3000 OR r.held >= 5 THEN c.tokens ELSE r.used + c.tokens END, CASE WHEN r.used + c.tokens > 3000 OR r.held >= 5 THEN 1 ELSE r.held + 1 END
              FROM r JOIN c ON c.source = r.source AND c.n = r.n + 1)
        SELECT doc_id, tokens, request FROM r""",
    "q59_registry": """WITH o AS (SELECT o_custkey AS key, max(o_totalprice) AS most, min(o_totalprice) AS least FROM orders GROUP BY 1),
        a AS (SELECT key, most AS value FROM o WHERE key % 3 <> 0), b AS (SELECT key, least AS value FROM o WHERE key % 2 = 0)
        SELECT coalesce(a.key, b.key) AS key, round(coalesce(b.value, a.value), 2) AS value, CASE WHEN a.key IS NULL THEN '' ELSE 'old' END AS file FROM a FULL JOIN b ON a.key = b.key""",
    "q61_vector_records": """SELECT doc_id AS id, CAST(len(embedding) AS INTEGER) AS width, CAST(length(substr(text, 1, 1000)) AS INTEGER) AS chars, lang, n_chars FROM documents JOIN embeddings ON vec_id = doc_id""",
    "q30_rate_limit": """WITH c AS (SELECT event_id AS id, date_trunc('hour', ts) AS m, date_trunc('day', ts) AS d FROM events),
        n AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY id) AS nm FROM c), k AS (SELECT *, nm <= 2 AS okm FROM n),
        o AS (SELECT *, count(*) FILTER (okm) OVER (PARTITION BY d ORDER BY m, id ROWS UNBOUNDED PRECEDING) AS nd FROM k)
        SELECT id, okm AND nd <= 12 AS allowed, CASE WHEN NOT okm THEN 'minute' WHEN nd > 12 THEN 'day' ELSE '' END AS reason,
        CAST(CASE WHEN NOT okm THEN 60 WHEN nd > 12 THEN greatest(1, 86400 - epoch(m) + epoch(d)) ELSE 0 END AS INTEGER) AS retry_after FROM o""",
    "q31_budget": """WITH RECURSIVE c AS (SELECT event_id AS id, date_trunc('day', ts) AS d, CAST(floor(value) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS n FROM events),
        r AS (SELECT d, n, id, tokens, tokens <= 500 AS granted, CASE WHEN tokens <= 500 THEN tokens ELSE 0 END AS used FROM c WHERE n = 1
              UNION ALL SELECT c.d, c.n, c.id, c.tokens, r.used + c.tokens <= 500, CASE WHEN r.used + c.tokens <= 500 THEN r.used + c.tokens ELSE r.used END FROM r JOIN c ON c.d = r.d AND c.n = r.n + 1)
        SELECT id, tokens, granted, used FROM r""",
    "q32_cache_hits": """WITH RECURSIVE c AS (SELECT event_id AS id, ts, event_type || '|' || (user_id % 20) AS k, event_id % 4 <> 0 AS clean,
              row_number() OVER (PARTITION BY event_type || '|' || (user_id % 20) ORDER BY ts, event_id) AS n FROM events),
        r AS (SELECT k, n, id, false AS hit, CASE WHEN clean THEN ts END AS stored FROM c WHERE n = 1
              UNION ALL SELECT c.k, c.n, c.id, coalesce(floor(epoch(c.ts)) - floor(epoch(r.stored)) < 86400, false), CASE WHEN coalesce(floor(epoch(c.ts)) - floor(epoch(r.stored)) < 86400, false) THEN r.stored WHEN c.clean THEN c.ts ELSE r.stored END
              FROM r JOIN c ON c.k = r.k AND c.n = r.n + 1)
        SELECT id, hit FROM r""",
    "q33_call_log_windows": """SELECT strftime(time_bucket(INTERVAL '240 minutes', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS tool, count(*) AS calls,
        count(*) FILTER (value > 60) AS errors, count(*) FILTER (value > 60) >= 1 AS alarm FROM events GROUP BY 1, 2""",
    "q65_latency_sketches": """SELECT event_type AS tool, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, count(*) AS calls, round(max(value), 6) AS worst, true AS p50_near, true AS p99_near FROM events GROUP BY 1, 2""",
    "q34_latency_percentiles": """SELECT event_type AS tool, count(*) AS calls, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS worst FROM events GROUP BY 1""",
}
