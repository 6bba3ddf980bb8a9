"""URL filter: a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import columns_of, held, released, saved

ALLOW, BLOCK = "allow", "block"
_FOUND = "struct<labels:int,length:int,allow:int,rule:string,verdict:string>"
#: A trie holds rules of so many characters and so many rules at most; more rules are judged in several rounds.
RULE_CHARS, RULE_COUNT = 64 << 20, 1_000_000


def host_of(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, with A to Z lower-cased."""
    return F.translate(
        F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "abcdefghijklmnopqrstuvwxyz",
    )


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class UrlTrie:
    """Rules by reversed host label, then by whole path segment.

    A rule's path is a prefix of the url's path as text, so its last segment may be cut short; such
    tails hang on the node of the segment before. Of the rules that fit, the one with more host labels
    wins, then the one with the longer path, then `allow` over `block`.
    """

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.hosts: dict = {}
        for host, path, verdict in sorted(rules, key=lambda r: r[2] == ALLOW):
            node = self.hosts
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            tails = node.setdefault(None, {})
            tails[tail] = (host.count("."), len(path), int(verdict == ALLOW), host + path, verdict)

    def match(self, host: str, path: str) -> tuple[int, int, int, str, str] | None:
        """Host labels, path length, whether allow, rule and verdict of the best rule that fits."""
        trees, node = [], self.hosts
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                trees.append(node[None])
        segments = path.split("/")
        for tree in reversed(trees):
            found, at = None, 0
            while tree is not None:
                tails = tree.get(None, {})
                for cut in range(len(segments[at]) + 1) if tails else ():
                    found = tails.get(segments[at][:cut], found)
                if at == len(segments) - 1:
                    break
                tree, at = tree.get(segments[at]), at + 1
            if found:
                return found
        return None


def _chunks(rules: list[tuple[str, str, str]] | DataFrame) -> Iterator[list[tuple[str, str, str]]]:
    """The rules in lists within the bounds of a trie; a table is read through them, never whole."""
    chunk, size = [], 0
    for rule in rules.select("host", "path", "verdict").toLocalIterator() if isinstance(rules, DataFrame) else rules:
        chunk.append(tuple(rule))
        size += len(rule[0]) + len(rule[1])
        if size >= RULE_CHARS or len(chunk) >= RULE_COUNT:
            yield chunk
            chunk, size = [], 0
    yield chunk


def _matches(trie):
    """Of a broadcast trie: what it finds for host and path."""

    @F.arrow_udf(_FOUND)
    def matches(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        names = ("labels", "length", "allow", "rule", "verdict")
        kind = pa.struct([*((n, pa.int32()) for n in names[:3]), *((n, pa.string()) for n in names[3:])])
        for hosts, paths in batches:
            found = (trie.value.match(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True))
            yield pa.array([f and dict(zip(names, f, strict=True)) for f in found], kind)

    return matches


def judge(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, url: str = "url", default: str = ALLOW) -> DataFrame:
    """Add host, path, rule and verdict to each row.

    rules: (host, path, verdict), as a list or a table; no nulls. A trie of at most RULE_CHARS characters goes to
    every task; more rules are dealt to several tries, one after the other, and the best rule of all counts. A url
    that is null, empty or without `://` has an empty host and path, fits no rule and gets the default. Urls of
    any length are judged whole. Repeated rows are judged alike; an empty table gives an empty result. Ties between
    rules go to `allow`. Columns of the input named like a result are replaced.
    """
    kept = columns_of(urls, "host", "path", "rule", "verdict")
    out = urls.select(held(kept), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.lit(None).cast(_FOUND).alias("best"))
    first = True
    for chunk in _chunks(rules):
        found = _matches(urls.sparkSession.sparkContext.broadcast(UrlTrie(chunk)))
        # saved between rounds, so that a task holds one trie at a time
        out = (out if first else saved(out)).withColumn("best", F.greatest("best", found("host", "path")))
        first = False
    return out.select(*released(kept), "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
