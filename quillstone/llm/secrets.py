"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds what was found in
each (blob, rule, rule version) that has been scanned; a run scans only the pairs that it lacks and joins
the findings of all blobs back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.llm.common import columns_of, saved, text_of


@dataclass(frozen=True)
class Rule:
    """pattern: Java regex. A match counts if its group has at least `least` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = (
    Rule("assign", 1, ASSIGN, 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),  # a run of 20 or more: the same matches as dropping shorter ones
    Rule("hex", 1, "[0-9a-f]{24,}+"),
)
ADDED_RULES = (
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + ADDED_RULES

SPAN = "struct<kind:string,start:int,stop:int>"
LEDGER = "blob string, rule string, spans array<" + SPAN + ">"


HITS = "array<struct<before:int,whole:int,good:boolean>>"


def hits_of(text: Column, rule: Rule) -> Column:
    """The rule's matches, leftmost and without overlap: how many code points come before each, how long it is, and
    whether it counts. The pieces between the matches and the matches themselves alternate."""
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("part"),
        F.split(text, rule.pattern, -1).alias("before"),
    )
    lengths = lambda m: F.struct(F.length(m["before"]).alias("before"), F.length(m["whole"]).alias("whole"), (F.length(m["part"]) >= rule.least).alias("good"))
    return F.when(text.rlike(rule.pattern), F.transform(F.filter(found, lambda m: m["whole"].isNotNull()), lengths)).otherwise(F.array().cast(HITS))


def _spans(scanned: DataFrame) -> DataFrame:
    """blob, rule and span of the matches that count: running sums over a blob's matches give the places."""
    each = scanned.select("blob", F.explode("new").alias("x")).select("blob", "x.rule", "x.kind", F.posexplode("x.hits").alias("nth", "hit"))
    before = F.sum(F.col("hit.before") + F.col("hit.whole")).over(W.partitionBy("blob", "rule").orderBy("nth")).cast("int")
    span = F.struct("kind", (before - F.col("hit.whole")).alias("start"), before.alias("stop")).alias("span")
    return each.select("blob", "rule", F.col("hit.good").alias("good"), span).filter("good").drop("good")


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Return (versions with their blob and spans, the ledger rows that this run adds).

    versions: one row for each version of each path. ledger: rows of LEDGER from earlier runs, or None. A
    null text is an empty blob; rows with equal text share one blob, which is scanned once; equal rows stay
    equal rows. A rule whose version has gone up is scanned again everywhere. The first result has every
    column of `versions` but the text, and blob and spans (ordered by start, then as the rules are listed).
    Ledger rows that repeat a pair count once. Texts of any length are scanned whole. Columns named like a
    result, in any case, are replaced. An empty table gives two empty results.
    """
    spark = versions.sparkSession
    order = {r.kind: i for i, r in enumerate(rules)}
    body = text_of(text)
    blobs = versions.select(F.sha2(body, 256).alias("blob"), body.alias("body")).dropDuplicates(["blob"])
    seen = ledger if ledger is not None else spark.createDataFrame([], LEDGER)
    wanted = [r.key for r in rules]
    seen = (
        seen.filter(F.col("rule").isin(wanted))
        .dropDuplicates(["blob", "rule"])
        .groupBy("blob")
        .agg(F.collect_set("rule").alias("done"), F.flatten(F.collect_list("spans")).alias("old"))
    )
    joined = blobs.join(seen, "blob", "left")
    todo = F.array_except(F.array(*map(F.lit, wanted)), F.coalesce("done", F.array().cast("array<string>")))
    none = F.expr(f"CAST(array() AS array<{SPAN}>)")
    new = F.array(*(F.struct(F.lit(r.key).alias("rule"), F.lit(r.kind).alias("kind"), F.when(F.array_contains("todo", r.key), hits_of(F.col("body"), r)).alias("hits")) for r in rules))
    # saved, so that the texts are scanned once, and so that Spark can split a blob with very many paths below
    scanned = saved(joined.withColumn("todo", todo).select("blob", "todo", F.coalesce("old", none).alias("old"), F.filter(new, lambda x: F.size(x["hits"]) > 0).alias("new")))
    spans = saved(_spans(scanned))
    pairs = scanned.select("blob", F.explode("todo").alias("rule"))
    added = pairs.join(spans.groupBy("blob", "rule").agg(F.array_sort(F.collect_list("span")).alias("spans")), ["blob", "rule"], "left").select("blob", "rule", F.coalesce("spans", none).alias("spans"))
    rank = F.create_map(*(F.lit(x) for item in order.items() for x in item))
    every = scanned.select("blob", F.explode("old").alias("span")).unionByName(spans.select("blob", "span"))
    keyed = every.select("blob", F.struct(F.col("span.start"), rank[F.col("span.kind")].alias("rank"), F.col("span.stop"), F.col("span.kind")).alias("key"))
    hits = keyed.groupBy("blob").agg(F.transform(F.array_sort(F.collect_list("key")), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))).alias("spans"))
    paths = versions.select(*columns_of(versions, text.lower(), "blob", "spans"), F.sha2(body, 256).alias("blob"))
    return paths.join(hits, "blob", "left").withColumn("spans", F.coalesce("spans", none)), added


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and spellings of the spans of each path."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    return found.select(
        key,
        *(count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES),
        F.sha2(spelled(base), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
    )
