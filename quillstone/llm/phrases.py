"""Phrase collocations by Rabin-Karp fingerprints.

Texts are read as bytes in windows. Prefix sums of a polynomial over the bytes give every word's hash, and
prefix sums of a polynomial over the words' hashes give the fingerprint of every n-gram, both in numpy. For each
length the fingerprints are counted by a shuffle, and those that reach the bound are set in a bit table of fixed
size; an n-gram can only reach it if both its (n-1)-grams do, so that only such n-grams are counted in the next
round. A filled bit table prunes less and loses nothing.

These rounds only choose what to look at; 40 bits of a fingerprint do for that. In the last round, n-grams are told
apart by 96 bits: the whole fingerprint and a check of another kind, sums of numbers that each byte draws at its
place in the word. What is shuffled are blocks: a task's counts by ranges of fingerprints, in order, as steps.

The pointer to an occurrence is the slot of its text, one byte of a hash, in the last round's blocks; the least slot
is kept. Phrases that reach the bound are then read from texts of that slot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.llm.common import saved, text_of
from quillstone.llm.hashing import ODD, mix

LONGEST, LEAST, SHARE, TOP, SCALE = 4, 30, 80, 2000, 2_000_000
#: Bytes of text that are looked at together.
WINDOW = 1 << 20
#: Bits of each table of frequent fingerprints: 16 MB.
FILTER_BITS = 27
#: Bits of a fingerprint that the rounds before the last count by.
CODE_BITS = 40
#: Bytes of phrases, about, that a task gathers before it gives them on.
WRITTEN = 8 << 20
SPACES, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"

_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)], _KIND[list(BREAKS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TRANSLATED = _LOWER.tobytes()
_VALUES = mix(np.arange(1, 257, dtype=np.uint64))[_LOWER]
_BACK = np.uint64(pow(ODD | 1, -1, 1 << 64))
_ODD = np.uint64(ODD | 1)
#: The columns of blocks: a key and its count; two keys, their count and the least slot.
CODES, EXACT = (np.uint64, np.int64), (np.uint64, np.uint32, np.int64, np.uint8)
_CODEC = pa.Codec("zstd", 1)


@cache
def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, base)]) for base in (_ODD, _BACK))
    return up, down


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least; longer ones than a window's are not kept."""
    size = 1 << max(10, int(n).bit_length())
    return _powers_to(size) if size <= 2 * WINDOW else _powers_to.__wrapped__(size)


def _slices(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Polynomial hashes of slices of the values, by prefix sums."""
    up, down = _powers(len(values))
    sums = np.r_[np.uint64(0), np.add.accumulate(values * up[: len(values)])]
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


def _cleared(prints: np.ndarray, cut: int) -> np.ndarray:
    """Fingerprints without their lowest bits."""
    return prints >> np.uint64(cut) << np.uint64(cut)


class Words:
    """The words of a window: hash (of the lower-cased bytes), row, piece, start and stop in the buffer."""

    def __init__(self, hashes, row, piece, start, stop):
        self.hash, self.row, self.piece, self.start, self.stop = hashes, row, piece, start, stop

    def tail(self, n: int) -> Words:
        return Words(*(x[max(0, len(x) - n) :] for x in (self.hash, self.row, self.piece, self.start, self.stop)))

    def after(self, other: Words | None) -> Words:
        if other is None:
            return self
        return Words(*(np.concatenate(x) for x in zip((other.hash, other.row, other.piece, other.start, other.stop), (self.hash, self.row, self.piece, self.start, self.stop), strict=True)))

    def grams(self, n: int, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of all runs of n words, and which of them lie in one piece. seeds: one for each row."""
        count = max(0, len(self.hash) - n + 1)
        at = np.arange(count)
        prints = _slices(self.hash, at, at + n)
        inside = self.piece[:count] == self.piece[n - 1 : n - 1 + count]
        return mix(prints ^ mix(seeds[self.row[:count]] + np.uint64(n))), inside


def windows(data: np.ndarray, bounds: np.ndarray, carry: int) -> Iterator[tuple[Words, int]]:
    """The words of texts that lie one after the other, window by window.

    bounds: where each text begins and the last ends. Each window begins with up to `carry` words of the one
    before, whose number is returned too. A window ends between two words, wherever texts end.
    """
    begin, pieces, last = int(bounds[0]), 0, None
    end_of_all = int(bounds[-1])
    while begin < end_of_all:
        end = min(begin + WINDOW, end_of_all)
        while end < end_of_all and _KIND[data[end]] == 0:  # on to the next separator, block by block
            ahead = np.flatnonzero(_KIND[data[end : min(end + 65536, end_of_all)]])
            end = end + int(ahead[0]) if len(ahead) else min(end + 65536, end_of_all)
        part = data[begin:end]
        kind = _KIND[part]
        word = kind == 0
        edges = bounds[np.searchsorted(bounds, begin) : np.searchsorted(bounds, end)] - begin
        before = np.r_[False, word[:-1]]
        before[edges] = False
        start = np.flatnonzero(word & ~before)
        follows = np.r_[word[1:], False]
        follows[edges[edges > 0] - 1] = False
        stop = np.flatnonzero(word & ~follows) + 1
        hashes = _slices(_VALUES[part], start, stop) if len(start) else np.empty(0, np.uint64)
        row = np.searchsorted(bounds, start + begin, "right") - 1
        breaks = np.flatnonzero(kind == 2)
        piece = pieces + np.searchsorted(breaks, start) + row
        pieces += len(breaks)
        own = Words(hashes, row, piece, start + begin, stop + begin)
        carried = 0 if last is None else len(last.hash)
        found = own.after(last)
        yield found, carried
        last, begin = found.tail(carry), end


def _holds(table: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether the bit table may hold the fingerprints."""
    mask = np.uint64((len(table) * 8) - 1)
    out = np.ones(len(prints), bool)
    for shift in (0, 32):
        bit = (prints >> np.uint64(shift)) & mask
        out &= (table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch's texts and the bounds of each."""
    column = batch.column("text").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data, bounds


def _summed(columns: list[np.ndarray], keys: int, kind: str = "stable") -> list[np.ndarray]:
    """One row for each key, in order: the keys, the sum of the counts, and the least of every column after them.

    columns: one or two columns of keys, the counts, any others. kind: of sorting; stable is fast on ordered runs.
    """
    if not len(columns[0]):
        return columns
    order = np.argsort(columns[0], kind=kind)
    columns_in = lambda order: [x[order] for x in columns]
    out = columns_in(order)
    new = np.r_[True, out[0][1:] != out[0][:-1]]
    if keys == 2 and np.any((out[1][1:] != out[1][:-1]) & ~new[1:]):  # fingerprints that collide
        out = columns_in(np.lexsort(columns[1::-1]))
        new = np.r_[True, (out[0][1:] != out[0][:-1]) | (out[1][1:] != out[1][:-1])]
    first = np.flatnonzero(new)
    return [*(x[first] for x in out[:keys]), np.add.reduceat(out[keys], first, dtype=out[keys].dtype), *(np.minimum.reduceat(x, first) for x in out[keys + 1 :])]


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns as bytes: steps of the first, which ascends; the bytes of equal weight lie together, zeros are left out."""
    steps = np.r_[columns[0][:1], np.diff(columns[0])]
    planes = [plane.tobytes() for x in (steps, *columns[1:]) for plane in x.view(np.uint8).reshape(len(x), -1).T]
    some = [plane.strip(b"\0") != b"" for plane in planes]
    return bytes(some) + b"".join(_CODEC.compress(plane, asbytes=True) for plane, kept in zip(planes, some, strict=True) if kept)


def unpacked(block: bytes, size: int, kinds: tuple[type, ...]) -> list[np.ndarray]:
    """The columns of `packed`, of these types."""
    widths = [np.dtype(kind).itemsize for kind in kinds]
    some = np.frombuffer(block, bool, sum(widths))
    planes = np.zeros((len(some), size), np.uint8)
    planes[some] = np.frombuffer(_CODEC.decompress(block[len(some) :], int(some.sum()) * size, asbytes=True), np.uint8).reshape(-1, size)
    ends = np.cumsum(widths)
    columns = [np.ascontiguousarray(planes[end - width : end].T).view(kind)[:, 0] for kind, width, end in zip(kinds, widths, ends, strict=True)]
    return [np.add.accumulate(columns[0]), *columns[1:]]


class Blocks:
    """A task's counts, added up by key and given on as (bucket, size, block) once they are many.

    A bucket has a range of the first key: its upper `bits` of `width`.
    """

    def __init__(self, keys: int, width: int, bits: int, most: int = 1_000_000):
        self.keys, self.shift, self.bits, self.most, self.parts, self.size = keys, np.uint64(width - bits), bits, most, [], 0

    def take(self, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """columns: see `_summed`."""
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size > self.most:
            self._merge()
            if self.size > self.most // 2:
                yield from self.rest()

    def _merge(self) -> None:
        self.parts = [_summed([np.concatenate(x) for x in zip(*self.parts, strict=True)], self.keys)]
        self.size = len(self.parts[0][0])

    def rest(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        self._merge()
        (columns,), self.parts, self.size = self.parts, [], 0
        edges = np.searchsorted(columns[0] >> self.shift, np.arange((1 << self.bits) + 1, dtype=np.uint64))
        full = np.flatnonzero(edges[1:] > edges[:-1])
        for some in np.array_split(full, -(-len(full) // 256)):
            blocks = [packed([x[edges[k] : edges[k + 1]] for x in columns]) for k in some]
            sizes = (edges[some + 1] - edges[some]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sizes), pa.array(blocks, pa.binary())], ["bucket", "size", "block"])


BLOCK = "bucket int, size int, block binary"


def _gathered(table: pa.Table, keys: int, kinds: tuple[type, ...], least: int) -> list[np.ndarray]:
    """What the blocks of a bucket add up to: the keys that reach the bound."""
    parts = [unpacked(block, size, kinds) for block, size in zip(table.column("block").to_pylist(), table.column("size").to_pylist(), strict=True)]
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    columns = _summed(columns, keys)
    return [x[columns[keys] >= least] for x in columns]


def counting(n: int, table: Callable[[], np.ndarray] | None, cut: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (text, seed) to BLOCK: the n-grams of each window that the table of (n-1)-grams lets through.

    cut: bits of a fingerprint that are dropped; 0 but for tests of collisions. bits: of the number of buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, filled = Blocks(1, CODE_BITS, bits), table() if table else None
        for batch in batches:
            data, bounds = _texts(batch)
            seeds = batch.column("seed").to_numpy(zero_copy_only=False).view(np.uint64)
            for words, carried in windows(data, bounds, LONGEST - 1):
                prints, good = words.grams(n, seeds)
                good[: max(0, carried - n + 1)] = False  # these were in the window before
                if filled is not None:
                    part = _holds(filled, _coded(words.grams(n - 1, seeds)[0], cut))
                    good &= part[:-1] & part[1:]
                found, count = np.unique(_cleared(prints[good], cut) >> np.uint64(64 - CODE_BITS), return_counts=True)
                yield from held.take([found, count])
        yield from held.rest()

    return run


def _coded(prints: np.ndarray, cut: int) -> np.ndarray:
    """What a bit table holds for fingerprints: the bits that were counted by, scattered."""
    return mix(_cleared(prints, cut) >> np.uint64(64 - CODE_BITS))


def reaching(least: int) -> Callable[[pa.Table], pa.Table]:
    """From the blocks of a bucket to (print): for a bit table, the fingerprints that reach the bound."""
    return lambda table: pa.table({"print": mix(_gathered(table, 1, CODES, least)[0]).view(np.int64)})


def _checks(data: np.ndarray, words: Words) -> np.ndarray:
    """A second hash of each word's lower-cased bytes: the sum of what every byte draws at its place."""
    if not len(words.start):
        return np.empty(0, np.uint64)
    size = words.stop - words.start
    ends = np.cumsum(size)
    place = np.arange(ends[-1]) - np.repeat(ends - size, size)
    byte = _LOWER[data[place + np.repeat(words.start, size)]]
    return np.add.reduceat(mix((place.astype(np.uint64) << np.uint64(8)) + byte + _ODD), ends - size)


def _chosen(data: np.ndarray, words: Words, carried: int, tables: list[np.ndarray], longest: int, seeds: np.ndarray, tongues: np.ndarray, cut: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The n-grams of a window that the tables let through: n, the first words, and the two keys of each."""
    shorter, checks = None, _checks(data, words)
    for n in range(1, longest + 1):
        prints, good = words.grams(n, seeds)
        if n <= len(tables):
            kept = _holds(tables[n - 1], _coded(prints, cut))
        else:
            kept = shorter[:-1] & shorter[1:] if len(shorter) > 1 else np.zeros(len(prints), bool)
        shorter = kept
        good = good & kept
        good[: max(0, carried - n + 1)] = False
        at = np.flatnonzero(good)
        both = tongues[words.row[at]] + np.uint64(n)
        for k in range(n):
            both += mix(checks[at + k] + np.uint64(k))
        yield n, at, _cleared(prints[at], cut), (mix(both) >> np.uint64(32)).astype(np.uint32)


def pointing(tables: list[Callable[[], np.ndarray]], longest: int, cut: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (text, seed, tongue, slot) to BLOCK: the n-grams that the tables let through and the least slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, held = [t() for t in tables], Blocks(2, 64, bits)
        for batch in batches:
            data, bounds = _texts(batch)
            seeds, tongues, slots = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("seed", "tongue", "slot"))
            slots = slots.astype(np.uint8)
            for words, carried in windows(data, bounds, LONGEST - 1):
                for _, at, prints, checks in _chosen(data, words, carried, filled, longest, seeds.view(np.uint64), tongues.view(np.uint64), cut):
                    yield from held.take(_summed([prints, checks, np.ones(len(at), np.int64), slots[words.row[at]]], 2, "quicksort"))
        yield from held.rest()

    return run


def _spots(prints: np.ndarray, checks: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """What a bit table holds for n-grams and slots."""
    return mix(prints ^ mix((checks.astype(np.uint64) << np.uint64(8)) + slots.astype(np.uint64)))


def counted(least: int) -> Callable[[pa.Table], pa.Table]:
    """From the blocks of a bucket to (k1, k2, f, print): the n-grams that reach the bound; print: see `_spots`."""

    def run(table: pa.Table) -> pa.Table:
        prints, checks, f, slots = _gathered(table, 2, EXACT, least)
        return pa.table({"k1": prints.view(np.int64), "k2": checks.view(np.int32), "f": f, "print": _spots(prints, checks, slots).view(np.int64)})

    return run


def reading(tables: list[Callable[[], np.ndarray]], spots: Callable[[], np.ndarray], longest: int, cut: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (lang, text, seed, tongue, slot) to (k1, k2, lang, n, phrase): n-grams in texts of the slots that `spots` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, spot, found, size = [t() for t in tables], spots(), {}, 0
        for batch in batches:
            data, bounds = _texts(batch)
            langs = batch.column("lang").to_pylist()
            seeds, tongues, slots = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("seed", "tongue", "slot"))
            for words, carried in windows(data, bounds, LONGEST - 1):
                for n, at, prints, checks in _chosen(data, words, carried, filled, longest, seeds.view(np.uint64), tongues.view(np.uint64), cut):
                    here = _holds(spot, _spots(prints, checks, slots[words.row[at]]))
                    prints, checks, _, at = _summed([prints[here], checks[here], np.ones(int(here.sum()), np.int64), at[here]], 2, "quicksort")
                    for k1, k2, i in zip(prints.view(np.int64).tolist(), checks.view(np.int32).tolist(), at.tolist(), strict=True):
                        if (k1, k2) not in found:
                            text = b" ".join([data[words.start[j] : words.stop[j]].tobytes() for j in range(i, i + n)]).translate(_TRANSLATED).decode()
                            found[k1, k2] = langs[words.row[i]], n, text
                            size += 50 + len(text)
                        if size > WRITTEN:
                            yield from _rows(found)
                            found, size = {}, 0
        yield from _rows(found)

    return run


def _rows(found: dict[tuple[int, int], tuple[str, int, str]]) -> Iterator[pa.RecordBatch]:
    if found:
        columns = [*zip(*found, strict=True), *zip(*found.values(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string()), strict=True)], ["k1", "k2", "lang", "n", "phrase"])


def bit_table(prints: DataFrame, bits: int = FILTER_BITS) -> Callable[[], np.ndarray]:
    """A bit table of fingerprints, of fixed size whatever their number, for all tasks to read."""
    mask = (1 << bits) - 1
    places = F.array(*(F.shiftrightunsigned("print", s).bitwiseAND(mask) for s in (0, 32)))
    each = prints.select(F.explode(places).alias("bit"))
    words = each.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("set")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words.column("word").to_numpy()] = words.column("set").to_numpy()
    shared = prints.sparkSession.sparkContext.broadcast(table)
    return lambda: shared.value.view(np.uint8)


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, cut: int = 0) -> tuple[DataFrame, DataFrame]:
    """(lang, n, phrase, f) of all phrases of up to `longest` words that occur `least` times, and (lang, n) of words."""
    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of("text").alias("text"))
    read = read.select("lang", "text", F.xxhash64("lang").alias("seed"))
    # some buckets for each task after the shuffle
    bits = min(12, max(8, (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length()))
    tables: list[Callable[[], np.ndarray]] = []
    for n in range(1, longest):
        blocks = read.select("text", "seed").mapInArrow(counting(n, tables[-1] if tables else None, cut, bits), BLOCK)
        tables.append(bit_table(blocks.groupBy("bucket").applyInArrow(reaching(least), "print long")))
    placed = read.withColumns({"tongue": F.xxhash64(F.lit(7), "lang"), "slot": F.xxhash64("text").bitwiseAND(255).cast("int")})
    blocks = placed.drop("lang").mapInArrow(pointing(tables, longest, cut, bits), BLOCK)
    exact = saved(blocks.groupBy("bucket").applyInArrow(counted(least), "k1 long, k2 int, f long, print long"))
    # a phrase is read wherever its slot is; once is enough
    rows = placed.mapInArrow(reading(tables, bit_table(exact), longest, cut), "k1 long, k2 int, lang string, n int, phrase string")
    found = saved(rows.join(exact.drop("print"), ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("lang", "n", "phrase", "f"))
    totals = read.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(r"[^ \t.,;:!?\n\x0B\f\r]+")).cast("long")).alias("n"))
    return found, totals


def _whole(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(20,0)")


def scored(phrases: DataFrame, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one covers. phrases: see `frequent`."""
    words = F.split("phrase", " ")
    candidates = phrases.filter("n >= 2")
    part = lambda at, n: F.array_join(F.slice(F.col("w"), at, n), " ")
    cuts = candidates.select("lang", "phrase", "n", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("n") - F.col("k")).alias("right"))
    known = lambda key, name: phrases.select("lang", F.col("phrase").alias(key), F.col("f").alias(name))
    cuts = cuts.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"])
    # whole numbers throughout: products need more than 64 bits
    cuts = cuts.withColumns({"up": _whole("a") * F.lit(SCALE).cast("decimal(7,0)"), "down": (_whole("l") + _whole("r")).cast("decimal(21,0)")})
    best = cuts.withColumn("score", F.expr("up div down")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("n") - size + 1), lambda at: part(at, size))))
    longer = candidates.filter("n > 2").select("lang", "n", "f", words.alias("w")).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "f")
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("over"))
    covered = _whole("over") * F.lit(100).cast("decimal(3,0)") >= _whole("a") * F.lit(share).cast("decimal(3,0)")
    out = best.join(longer, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False)))
    return out.select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, longest: int = LONGEST, cut: int = 0) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `longest` words.

    A to Z are lower-cased. Texts are split into pieces at .,;:!? and line ends, and those into words at spaces
    and tabs; phrases lie within pieces and occur `least` times, overlaps included. The score floor(2000000 a /
    (l + r)) is that of the lowest cut. A candidate goes if a longer one that contains it occurs `share` per cent
    as often. Ties in score go by a, then by the phrase's bytes. Null texts are empty, a null language is `und`.
    Rows count as often as they are there. Texts and words of any length are read whole. Empty tables and tables
    without frequent phrases give an empty result. Other columns are ignored, whatever their names.
    """
    phrases, totals = frequent(docs, least, longest, cut)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = scored(phrases, least, share).withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
