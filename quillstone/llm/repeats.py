"""Removal of repeated byte strings: maximal repeats from interval trees over enhanced suffix arrays.

A suffix array of a whole corpus would be one sorted sequence of all its bytes. Instead every string of `span`
bytes has an anchor, the least hash of the GRAM-byte strings in it. Equal strings have equal anchors, so the
text falls into stretches that start strings of one anchor, and only stretches that share an anchor can repeat
each other. Equal stretches are collapsed by 80 bits of a collision-resistant digest before anything is shuffled. Unequal
ones that share an anchor meet. There a suffix array over them, with the common prefixes of neighbours, is
scanned with a stack: the intervals are the nodes of a tree, and a node at least `span` deep whose occurrences
differ in the byte to the left is a maximal repeat with all its occurrences.

An anchor that very many unequal stretches share (a passage in a large part of all documents, whose stretches
differ in the bytes outside it) is dealt out: its strings are stretches of their own, with a hash of all their
bytes as anchor, so that only equal strings meet, and those are collapsed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import text_of
from quillstone.llm.hashing import ODD, mix

SPAN, GRAM = 50, 16
#: Bytes of text for each part of the anchors and of the stretches.
ANCHOR_PART, STRETCH_PART = 24 << 20, 8 << 20
#: Documents that are handled together, across Arrow batches.
GROUP_BYTES = 8 << 20
#: String starts of a stretch; longer ones, which only text with a period has, are cut.
WIDE = 64
#: An anchor of so many unequal stretches is dealt out. They are counted on a sample of the texts, one in SPARSE or
#: SAMPLE_BYTES if that is more; the sample decides only how the work is dealt, never the result.
HOT, SPARSE, SAMPLE_BYTES, HOT_ANCHORS = 4096, 256, 64 << 20, 2_000_000
#: A null document sorts after all others.
LAST = (1 << 63) - 1
_POWERS = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD))
#: The first n bytes of a word of eight.
_HEADS = np.array([0, *(((1 << 8 * n) - 1) << 8 * (8 - n) for n in range(1, 9))], np.uint64)


def grams(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM-byte string at every place."""
    if len(data) < GRAM:
        return np.empty(0, np.uint64)
    h, width = _BYTES[data], 1
    while width < GRAM:
        h = h[:-width] * np.uint64(pow(ODD, width, 1 << 64)) + h[width:]
        width *= 2
    return mix(h)


def anchors(hashes: np.ndarray, span: int = SPAN) -> np.ndarray:
    """For every place where a string of `span` bytes starts, the anchor of that string; from the grams."""
    window = span - GRAM + 1
    if len(hashes) < window:
        return np.empty(0, np.uint64)
    h, width = hashes, 1
    while 2 * width <= window:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (window - width)], h[window - width :]) if window > width else h


def stretches(found: np.ndarray, wide: int = WIDE) -> tuple[np.ndarray, np.ndarray]:
    """First and one past last start of each run of equal anchors, cut to at most `wide` starts."""
    if not len(found):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.flatnonzero(found[1:] != found[:-1]) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(found)]
    if (last - first).max() > wide:
        pieces = -(-(last - first) // wide)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + nth * wide
        last = np.minimum(first + wide, np.repeat(last, pieces))
    return first, last


def _pieces(body: np.ndarray, span: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor, first start, one past last start, and the two halves of the digest of every stretch of a text."""
    g = grams(body)
    h = anchors(g, span)
    first, last = stretches(h)
    h = h[first] if len(first) else h
    if len(hot) and len(h):
        spread = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
        if spread.any():
            n = (last - first)[spread]
            each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[spread], n)
            own = np.zeros(len(each), np.uint64)
            for at in [*range(0, span - GRAM, GRAM), span - GRAM]:
                own = mix(own + np.uint64(at) ^ g[each + at])
            h, first, last = np.r_[h[~spread], own], np.r_[first[~spread], each], np.r_[last[~spread], each + 1]
    raw, digest = body.tobytes(), hashlib.blake2b
    found = b"".join([digest(raw[a:b], digest_size=10).digest() for a, b in zip(first.tolist(), (last + (span - 1)).tolist(), strict=True)])
    halves = np.frombuffer(found, np.dtype([("a", "<u8"), ("b", "<u2")]))
    return h, first, last, halves["a"], halves["b"]


def intervals(depths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stack scan: (depth, first, last) of every interval of suffixes whose common prefix is at least so deep.

    depths[i] is the common prefix of the suffixes i - 1 and i; depths[0] is 0.
    """
    out: list[tuple[int, int, int]] = []
    deep = np.flatnonzero(depths >= least)
    stack: list[list[int]] = []
    before = -2
    values = depths[deep].tolist()
    for i, d in zip(deep.tolist(), values, strict=True):
        if i != before + 1:
            out += [(s[0], s[1], before) for s in stack]
            stack = []
        first = i - 1
        while stack and stack[-1][0] > d:
            top = stack.pop()
            out.append((top[0], top[1], i - 1))
            first = top[1]
        if not stack or stack[-1][0] < d:
            stack.append([d, first])
        before = i
    out += [(s[0], s[1], before) for s in stack]
    flat = np.array(out, np.int64).reshape(-1, 3)
    return flat[:, 0], flat[:, 1], flat[:, 2]


def suffixes(data: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The enhanced suffix array of strings that lie one after the other in data and end at `ends`.

    Returns place, string and common prefix with the one before, in ascending order, of the suffixes that share
    their first `least` bytes with another (by a hash, so a few others may be among them); a string's end sorts
    first. Words of eight bytes are compared; what ties on the first words is sorted on by the next ones, to the
    end of the longest string.
    """
    begins = np.r_[0, ends[:-1]]
    runs = np.maximum(ends - begins - least + 1, 0)
    which = np.repeat(np.arange(len(ends)), runs)
    places = np.arange(len(which)) - np.repeat(np.cumsum(runs) - runs, runs) + begins[which]
    longest = int((ends - begins).max(initial=0))
    padded = np.r_[data, np.zeros(longest + 8, np.uint8)]
    eights = np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,))

    def word(at: np.ndarray, rest: np.ndarray, j: int) -> np.ndarray:
        return eights[at + 8 * j].astype(np.uint64) & _HEADS[np.clip(rest - 8 * j, 0, 8)]

    rest, step = ends[which] - places, -(-least // 8)
    key, whole = np.zeros(len(places), np.uint64), np.full(len(places), least)
    for j in range(step):
        key = (key ^ word(places, whole, j)) * np.uint64(ODD)
        key ^= key >> np.uint64(29)
    by = np.argsort(key)
    twice = key[by][1:] == key[by][:-1]
    several = np.sort(by[np.r_[False, twice] | np.r_[twice, False]]) if len(by) else by
    places, which, rest = places[several], which[several], rest[several]
    order, depth = np.arange(len(places)), np.zeros(len(places), np.int64)
    run, at, tied = np.zeros(len(places), np.int64), 0, np.arange(len(places))
    while len(tied):
        pick = order[tied]
        columns = [word(places[pick], rest[pick], at + j) for j in range(step)]
        by = np.lexsort((rest[pick], *columns[::-1], run))
        order[tied], pick = pick[by], pick[by]
        same = run[by][1:] == run[by][:-1]
        for c in columns:
            x = c[by]
            differ = x[1:] ^ x[:-1]
            depth[tied[1:]] += np.where(same, np.where(differ == 0, 8, 7 - np.searchsorted(_POWERS, differ, side="right")), 0)
            same &= differ == 0
        at += step
        same &= np.minimum(rest[pick][1:], rest[pick][:-1]) > 8 * at  # the rest of a suffix that has ended is empty
        inside = np.r_[False, same] | np.r_[same, False]
        run, tied = np.cumsum(np.r_[True, ~same])[inside] if len(same) else run[:0], tied[inside]
    places, which, rest = places[order], which[order], rest[order]
    depth[1:] = np.minimum(depth[1:], np.minimum(rest[1:], rest[:-1]))
    depth[:1] = 0
    return places, which, depth


def repeats(data: np.ndarray, ends: np.ndarray, owners: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats of at least `span` bytes among strings that lie one after the other in data and end at `ends`.

    Returns group, place, depth and owner of every occurrence of every maximal repeat. A string's beginning
    counts as a left neighbour of its own.
    """
    places, which, depth = suffixes(data, ends, span)
    begins = np.r_[0, ends[:-1]]
    deep, first, last = intervals(depth, span)
    inside = places > begins[which]
    left = np.where(inside, data[np.maximum(places - 1, 0)].astype(np.int64), -1 - np.arange(len(places))) if len(places) else places
    change = np.cumsum(np.r_[0, left[1:] != left[:-1]]) if len(left) else np.empty(0, np.int64)
    keep = change[last] > change[first] if len(deep) else np.empty(0, bool)
    deep, first, last = deep[keep], first[keep], last[keep]
    sizes = last - first + 1
    group = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[group]
    return group, places[at], deep[group], owners[which[at]]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of all batches in groups of bounded size; the text as an array of bytes."""
    group, size = [], 0
    for batch in batches:
        rest = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
        text = batch.column(batch.schema.names.index("text")).cast(pa.large_binary())
        for i in range(batch.num_rows):
            body = np.frombuffer(text[i].as_buffer(), np.uint8)
            group.append((body, *(c[i].as_py() for c in rest)))
            size += len(body)
            if size > GROUP_BYTES:
                yield group
                group, size = [], 0
    if group:
        yield group


def _edges(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _cuts(*keys: np.ndarray) -> list[tuple[int, int]]:
    edge = _edges(*keys)
    return list(zip(edge.tolist(), [*edge[1:].tolist(), len(keys[0])], strict=True)) if len(edge) else []


def _by_content(c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal digests together, and where each begins in it."""
    order = np.argsort(c0, kind="stable")
    a, b = c0[order], c1[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((c1, c0))
        a, b = c0[order], c1[order]
    return order, _edges(a, b)


def merged(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Rows (start, stop) of the union of ranges; starts ascending. Ranges that touch become one."""
    if not len(starts):
        return np.empty((0, 2), np.int64)
    reach = np.maximum.accumulate(stops)
    new = np.r_[True, starts[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    return np.column_stack([starts[at], reach[np.r_[at[1:] - 1, len(starts) - 1]]]).astype(np.int64)


def _merged_by_text(docs: np.ndarray, tags: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """The union of each text's ranges, in the order of (doc, tag, start)."""
    order = np.lexsort((starts, tags, docs))
    docs, tags, starts, stops = docs[order], tags[order], starts[order], stops[order]
    out = [(docs[a], tags[a], merged(starts[a:b], stops[a:b])) for a, b in _cuts(docs, tags)]
    sizes = [len(x) for *_, x in out]
    ranges = np.concatenate([x for *_, x in out]) if out else np.empty((0, 2), np.int64)
    return np.repeat(np.array([d for d, *_ in out], np.int64), sizes), np.repeat(np.array([t for _, t, _ in out], np.int64), sizes), ranges[:, 0], ranges[:, 1]


def squeezed(values: np.ndarray, rising: bool = False) -> bytes:
    """An array as few bytes: byte by byte of all numbers, of their differences if they mostly rise."""
    x = np.diff(values, prepend=values.dtype.type(0)) if rising else np.ascontiguousarray(values)
    planes = x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def restored(raw: bytes, kind: type, rising: bool = False) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    if not size:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.decompress(raw[8:], size, codec="zstd"), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    x = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if rising else x


def _column(rows: pd.DataFrame, name: str, kind: type, rising: bool = False) -> np.ndarray:
    return np.concatenate([restored(x, kind, rising) for x in rows[name]]) if len(rows) else np.empty(0, kind)


_PLACES = ("docs", "tags", "runs", "starts", "sizes")
_ANCHOR_ROWS = "part long, docs binary, tags binary, runs binary, starts binary, sizes binary, anchors binary, c0 binary, c1 binary"
_NOTED_ROWS = "bin long, docs binary, tags binary, runs binary, starts binary, sizes binary, parts binary"


def _packed(docs: np.ndarray, tags: np.ndarray, starts: np.ndarray, stops: np.ndarray, size: type = np.uint32) -> tuple[bytes, ...]:
    """Ranges of texts; texts that follow each other are written once, with their number."""
    edge = _edges(docs, tags)
    runs = np.diff(np.r_[edge, len(docs)]).astype(np.uint32)
    return squeezed(docs[edge], True), squeezed(tags[edge]), squeezed(runs), squeezed(starts.astype(np.uint32), True), squeezed((stops - starts).astype(size))


def _unpacked(rows: pd.DataFrame, size: type = np.uint32) -> tuple[np.ndarray, ...]:
    kinds = ((np.int64, True), (np.int64, False), (np.uint32, False), (np.uint32, True), (size, False))
    docs, tags, runs, starts, sizes = (_column(rows, c, *kind) for c, kind in zip(_PLACES, kinds, strict=True))
    starts = starts.astype(np.int64)
    return np.repeat(docs, runs), np.repeat(tags, runs), starts, starts + sizes


_ANCHOR_SCHEMA = pa.schema([("part", pa.int64()), *((c, pa.binary()) for c in (*_PLACES, "anchors", "c0", "c1"))])


def _bins(docs: np.ndarray, tags: np.ndarray, parts: int) -> np.ndarray:
    return (mix(docs.astype(np.uint64) ^ mix(tags.astype(np.uint64))) % np.uint64(parts)).astype(np.int64)


def _emit_anchors(span: int, parts: int, hot):
    """Rows of a part: stretches with the rest of their anchors, their digests and where they stand.

    Of the documents of a group that share a stretch only the smallest is asked about. In the others it is
    known to repeat; such ranges are only passed on, in parts (below 0) dealt by document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches):
            found = [_pieces(body, span, hot.value) for body, *_ in group]
            h, first, last, c0, c1 = (np.concatenate([f[i] for f in found]) for i in range(5))
            sizes = [len(f[0]) for f in found]
            docs, tags = (np.repeat(np.array([g[i] for g in group], np.int64), sizes) for i in (1, 2))
            order, begin = _by_content(c0, c1)
            least = np.repeat(np.minimum.reduceat(docs[order], begin), np.diff(np.r_[begin, len(order)])) if len(order) else docs
            known = np.zeros(len(h), bool)
            known[order] = docs[order] > least
            rows: list[tuple] = []
            d, t, a, b = _merged_by_text(docs[known], tags[known], first[known], last[known] + span - 1)
            bins = _bins(d, t, parts)
            by = np.argsort(bins, kind="stable")
            for i, j in _cuts(bins[by]):
                pick = by[i:j]
                rows.append((-1 - int(bins[pick[0]]), *_packed(d[pick], t[pick], a[pick], b[pick]), None, None, None))
            part = (h % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            by = by[~known[by]]
            for i, j in _cuts(part[by]):
                pick = by[i:j]
                rows.append((int(part[pick[0]]), *_packed(docs[pick], tags[pick], first[pick], last[pick], np.uint8), squeezed((h[pick] >> np.uint64(32)).astype(np.uint32)), squeezed(c0[pick]), squeezed(c1[pick])))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(_ANCHOR_SCHEMA.names, zip(*rows, strict=True), strict=True)), schema=_ANCHOR_SCHEMA)

    return run


def _shared(span: int, parts: int, fine: int):
    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        """Of one part: the ranges that a smaller document repeats, and the stretches to compare byte by byte (with
        a part of the comparison, else -1), in bins of documents.

        A stretch is compared if it is the smallest document's and its anchor also starts other stretches, of other
        documents. The smallest document of a stretch stands for all: whatever of it is in another, is in this one.
        """
        docs, tags, starts, stops = _unpacked(d, np.uint32 if key[0] < 0 else np.uint8)
        if key[0] < 0:
            to = np.full(len(docs), -1, np.int64)
        else:
            h, c0, c1 = _column(d, "anchors", np.uint32), _column(d, "c0", np.uint64), _column(d, "c1", np.uint16)
            order, begin = _by_content(c0, c1)
            docs, tags, starts, stops, h = docs[order], tags[order], starts[order], stops[order], h[order]
            size = np.diff(np.r_[begin, len(order)])
            late = docs > np.repeat(np.minimum.reduceat(docs, begin), size)
            # an anchor is open if stretches of several contents and several smallest documents have it
            at, least = h[begin], np.minimum.reduceat(docs, begin)
            by = np.argsort(at, kind="stable")
            group = _edges(at[by])
            several = np.minimum.reduceat(least[by], group) != np.maximum.reduceat(least[by], group)
            open_ = np.zeros(len(begin), bool)
            open_[by] = np.repeat(several, np.diff(np.r_[group, len(by)]))
            ask = np.repeat(open_, size) & ~late
            to = np.where(ask, key[0] * fine + (h % np.uint32(fine)).astype(np.int64), -1)
            keep = late | ask
            docs, tags, starts, stops, to = docs[keep], tags[keep], starts[keep], (stops + np.where(late, span - 1, 0))[keep], to[keep]
        bins = _bins(docs, tags, parts)
        by = np.argsort(bins, kind="stable")
        rows = [(int(bins[by[i]]), *_packed(docs[by[i:j]], tags[by[i:j]], starts[by[i:j]], stops[by[i:j]]), squeezed(to[by[i:j]])) for i, j in _cuts(bins[by])]
        return pd.DataFrame(rows, columns=["bin", *_PLACES, "parts"])

    return run


def _by_text(d: pd.DataFrame) -> pd.DataFrame:
    """Of one bin: one row for each text, with the ranges that go and the stretches to compare."""
    docs, tags, starts, stops = _unpacked(d)
    to = _column(d, "parts", np.int64)
    order = np.lexsort((starts, to >= 0, tags, docs))
    docs, tags, starts, stops, to = docs[order], tags[order], starts[order], stops[order], to[order]
    out: dict[str, list] = {k: [] for k in ("of", "tag", "gone", "starts", "stops", "parts")}
    for i, j in _cuts(docs, tags):
        mid = i + int(np.searchsorted(to[i:j] >= 0, True))
        for name, value in zip(out, (docs[i], tags[i], merged(starts[i:mid], stops[i:mid]).tobytes(), starts[mid:j].tobytes(), stops[mid:j].tobytes(), to[mid:j].tobytes()), strict=True):
            out[name].append(value)
    return pd.DataFrame(out)


_STRETCH_ROWS = "part long, data binary, ends binary, docs binary, tags binary, starts binary"


def _emit_stretches(span: int, parts: int):
    """Rows of a part: the bytes of stretches to compare, and as ends their lengths; and, with no ends, ranges that are known to go, their
    lengths as data. Rows that repeat a text and its document come one after the other, and count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for group in _grouped(batches):
            compare: list[tuple] = []
            rows: dict[str, list] = {k: [] for k in ("part", "data", "ends", "docs", "tags", "starts")}
            for body, doc, tag, gone, *asked in group:
                if (doc, tag) == before:
                    continue
                before = (doc, tag)
                spans = np.frombuffer(gone, np.int64).reshape(-1, 2)
                if len(spans):
                    row = (int(_bins(np.array([doc]), np.array([tag]), parts)[0]), squeezed(spans[:, 1] - spans[:, 0]), None, *(squeezed(np.full(len(spans), x, np.int64)) for x in (doc, tag)), squeezed(spans[:, 0]))
                    for name, value in zip(rows, row, strict=True):
                        rows[name].append(value)
                for a, b, p in zip(*(np.frombuffer(x, np.int64).tolist() for x in asked), strict=True):
                    compare.append((p, body[a : b + span - 1].tobytes(), doc, tag, a))
            compare.sort(key=lambda e: e[0])
            for i, j in _cuts(np.array([e[0] for e in compare], np.int64)):
                some = compare[i:j]
                row = (some[0][0], squeezed(np.frombuffer(b"".join(e[1] for e in some), np.uint8)), squeezed(np.array([len(e[1]) for e in some], np.int64)), *(squeezed(np.array([e[k] for e in some], np.int64)) for k in (2, 3, 4)))
                for name, value in zip(rows, row, strict=True):
                    rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("part", pa.int64()), *((k, pa.binary()) for k in list(rows)[1:])]))

    return run


def _removed(span: int):
    def run(d: pd.DataFrame) -> pd.DataFrame:
        """Of one part: for each text the byte ranges that occur in a smaller document."""
        judged = d["ends"].notna()
        through, some = d[~judged], d[judged]
        docs, tags, starts, lengths = ([_column(through, c, np.int64)] for c in ("docs", "tags", "starts", "data"))
        if len(some):
            data, ends = _column(some, "data", np.uint8), np.cumsum(_column(some, "ends", np.int64))
            owner, tag, begin = (_column(some, c, np.int64) for c in ("docs", "tags", "starts"))
            group, place, depth, string = repeats(data, ends, np.arange(len(ends)), span)
            if len(group):
                own = owner[string]
                least = np.minimum.reduceat(own, _edges(group))[group]
                late = own > least
                string, place, depth = string[late], place[late], depth[late]
                docs.append(owner[string])
                tags.append(tag[string])
                starts.append(begin[string] + place - np.r_[0, ends[:-1]][string])
                lengths.append(depth)
        docs, tags, starts, lengths = (np.concatenate(x) for x in (docs, tags, starts, lengths))
        docs, tags, starts, stops = _merged_by_text(docs, tags, starts, starts + lengths)
        cuts = _cuts(docs, tags)
        return pd.DataFrame({"of": [int(docs[i]) for i, _ in cuts], "tag": [int(tags[i]) for i, _ in cuts], "ranges": [np.column_stack([starts[i:j], stops[i:j]]).tobytes() for i, j in cuts]}).astype({"of": "int64", "tag": "int64"})

    return run


_CUT = "struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string,kept:binary>"


def _cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    for texts, found, want in batches:
        out = []
        keep = len(want) > 0 and want[0].as_py()
        for text, ranges in zip(texts, found, strict=True):
            body = text.as_py().encode("utf-8")
            parts = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in ranges.as_py() or ()]
            spans = np.concatenate(parts) if parts else np.empty((0, 2), np.int64)
            spans = spans[np.argsort(spans[:, 0], kind="stable")]
            spans = merged(spans[:, 0], spans[:, 1])
            at, pieces = 0, []
            for a, b in spans.tolist():
                pieces.append(body[at:a])
                at = b
            left = b"".join([*pieces, body[at:]])
            out.append((len(body), len(body) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left if keep else None))
        yield pa.array([dict(zip(("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"), o, strict=True)) for o in out], kind)


class _None:
    """No hot anchors, as a broadcast would hold them."""

    value = np.empty(0, np.uint64)


def hot_anchors(texts: DataFrame, total: int, span: int = SPAN, hot: int = HOT) -> np.ndarray:
    """Anchors that about `hot` or more unequal stretches share, ascending; at most HOT_ANCHORS, the largest.

    They are counted on a sample of the texts by a hash.
    """
    share = min(1.0, max(1 / SPARSE, SAMPLE_BYTES / max(total, 1)))
    sample = texts if share == 1 else texts.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches):
            found = [_pieces(body, span, _None.value) for body, *_ in group]
            h, _, _, c0, c1 = (np.concatenate([f[i] for f in found]) for i in range(5))
            order, begin = _by_content(c0, c1)
            h, n = np.unique(h[order[begin]], return_counts=True)
            yield pa.RecordBatch.from_pydict({"anchor": h.view(np.int64), "n": n})

    counts = sample.select("text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    counts = counts.filter(F.col("n") >= max(32, int(hot * share))).orderBy(F.desc("n")).limit(HOT_ANCHORS)
    return np.sort(counts.select("anchor").toPandas()["anchor"].to_numpy(np.int64).view(np.uint64))


def without_repeats(docs: DataFrame, span: int = SPAN, keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) for each row.

    Removed is every byte covered by a string of `span` bytes that also occurs in a document with a smaller
    doc_id, judged on the input. doc_ids are whole numbers below 2^63 - 1. Null doc_ids come after all others and
    do not repeat each other; rows that share a doc_id do not repeat each other either. Null texts are empty.
    Rows that repeat stay. A text of any length is judged whole; one task holds it with arrays of about 50 times
    its size. An empty table gives an empty result; other columns are ignored. `span` is at least twice GRAM.
    Anchors of `hot` unequal stretches and more are dealt out; this changes no result.
    """
    if span < 2 * GRAM:
        raise ValueError(f"span must be at least {2 * GRAM}")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("of"), text_of("text").alias("text")).withColumn("tag", F.xxhash64("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // ANCHOR_PART))
    fine = max(1, ANCHOR_PART // STRETCH_PART)
    spread = docs.sparkSession.sparkContext.broadcast(hot_anchors(texts, total, span, hot))
    # as many tasks as parts: a task's share does not grow with the input
    rows = texts.select("text", "of", "tag").mapInArrow(_emit_anchors(span, parts, spread), _ANCHOR_ROWS).repartition(4 * parts, "part")
    shared = rows.groupBy("part").applyInPandas(_shared(span, parts, fine), _NOTED_ROWS).repartition(parts, "bin")
    noted = shared.groupBy("bin").applyInPandas(_by_text, "of long, tag long, gone binary, starts binary, stops binary, parts binary")
    # the texts are joined twice by the same keys, with the same columns, so Spark shuffles them once
    found = texts.join(noted, ["of", "tag"]).select("text", "of", "tag", "gone", "starts", "stops", "parts")
    found = found.mapInArrow(_emit_stretches(span, parts * fine), _STRETCH_ROWS).repartition(parts * fine, "part")
    found = found.groupBy("part").applyInPandas(_removed(span), "of long, tag long, ranges binary")
    found = found.groupBy("of", "tag").agg(F.collect_list("ranges").alias("found"))
    out = texts.join(found, ["of", "tag"], "left")
    out = out.withColumn("cut", F.arrow_udf(_cut, _CUT).asNondeterministic()("text", "found", F.lit(keep_text)))
    doc_id = F.when(F.col("of") != LAST, F.col("of")).cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return out.select(doc_id, "cut.n_bytes", "cut.n_removed", "cut.n_spans", "cut.kept_sha256", *(["cut.kept"] if keep_text else []))
