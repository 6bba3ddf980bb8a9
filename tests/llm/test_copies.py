"""SimHash, repeat removal and line dedup against brute force."""

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import graphs, lines, repeats, simhash

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n))


def corpus():
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    rows = [(i, prose(100 + i, 60)) for i in range(20)]
    rows += [(50, base), (51, base), (52, " ".join(near)), (53, ""), (54, None), (55, "one"), (56, "tiny words here"), (57, base.upper()), (58, "x " * 3000)]
    rows += [(59, prose(7, 30) + "\n" + base[:200] + "\n" + prose(8, 30)), (60, "é" * 80 + base[100:180]), (61, "ß" * 5 + "é" * 80)]
    return rows


def test_simhash_classes_match_brute_force(documents):
    rows = corpus() + [(50, corpus()[20][1]), (None, "null key text alone")]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.classes(documents(rows, print="clash", root=1)).collect()}
    prints = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[j : j + 4]) for j in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(i for i in prints if i is not None)
    group = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    assert got == {(i, f"{prints[i]:016x}", group[i]) for i in ids} | {(None, f"{prints[None]:016x}", None)}


def test_simhash_of_nothing(documents):
    assert simhash.classes(documents([])).count() == 0
    assert simhash.one_of_each(documents([])).count() == 0


def test_one_of_each_keeps_columns_and_least_id(documents):
    docs = documents(corpus())
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 50 in ids and not {51, 57} & ids and {53, 54} & ids == {53}


def test_oversized_shards_lose_no_link(spark):
    values = [(1 << i) for i in range(40)] + [0] + [(1 << 63) | (1 << i) for i in range(30)]
    prints = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "print long")
    roots = {r.root for r in simhash.groups(prints, shard=4).collect()}
    assert len(roots) == 1


@given(st.lists(st.integers(0, 2**64 - 1), max_size=25), st.integers(0, 6))
@settings(max_examples=40, deadline=None)
def test_bk_tree_finds_all_within_radius(values, radius):
    tree = simhash.BKTree()
    for i, v in enumerate(values):
        assert sorted(tree.near(v, radius)) == [j for j in range(i) if (values[j] ^ v).bit_count() <= radius]
        tree.add(v, i)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in graphs.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def brute_repeats(rows, span=50):
    seen = {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (text or "").encode()
        key = float("inf") if i is None else i
        for s in range(len(b) - span + 1):
            seen.setdefault(b[s : s + span], key)
    out = []
    for i, text in rows:
        b, key = (text or "").encode(), float("inf") if i is None else i
        gone = bytearray(len(b))
        for s in range(len(b) - span + 1):
            if seen[b[s : s + span]] < key:
                gone[s : s + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats_match_brute_force(documents):
    rows = corpus() + [(70, "a" * 500), (71, "a" * 300), (72, "ab" * 200), (73, "b" + "ab" * 100), (None, corpus()[20][1]), (50, prose(3, 40)), (74, "\0" * 120), (75, "\0" * 90 + "z")]
    got = repeats.without_repeats(documents(rows, of=3, cut="clash")).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_repeats(rows)


def test_repeats_across_many_documents(documents):
    r = random.Random(5)
    passages = [prose(900 + i, 25) for i in range(6)]
    rows = [(i, prose(i, 15) + " " + r.choice(passages)[r.randrange(20) :] + " " + prose(i + 500, 10) + r.choice(passages)[: r.randrange(40, 120)]) for i in range(60)]
    got = repeats.without_repeats(documents(rows)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_repeats(rows)


def test_repeats_with_hot_anchors(documents):
    passage = prose(77, 30)
    rows = [(i, prose(2000 + i, 12) + passage + prose(3000 + i, 12)) for i in range(50)] + [(None, passage), (None, passage), (60, "ab" * 400), (61, "c" + "ab" * 300)]
    texts = documents(rows)
    got = repeats.without_repeats(texts, hot=8).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_repeats(rows)


def maximal(strings, span):
    """Every string of at least span bytes that occurs twice and can be made longer on neither side."""
    out = {}
    for n in range(span, max(map(len, strings)) + 1):
        found = {}
        for i, s in enumerate(strings):
            for p in range(len(s) - n + 1):
                found.setdefault(s[p : p + n], []).append((i, p))
        for text, places in found.items():
            left = {strings[i][p - 1] if p else (i, p) for i, p in places}
            right = {strings[i][p + n] if p + n < len(strings[i]) else (i, p) for i, p in places}
            if len(places) > 1 and len(left) > 1 and len(right) > 1:
                out[text] = sorted(places)
    return out


@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=6), st.integers(3, 20))
@settings(max_examples=60, deadline=None)
def test_intervals_are_the_maximal_repeats(strings, span):
    strings = [s.encode() for s in strings]
    ends = np.cumsum([len(s) for s in strings])
    data = np.frombuffer(b"".join(strings), np.uint8)
    group, place, depth, string = repeats.repeats(data, ends, np.arange(len(ends)), span)
    got = {}
    for g, p, d, s in zip(group, place, depth, string, strict=True):
        at = int(p - (ends[s] - len(strings[s])))
        got.setdefault((g, strings[s][at : at + d]), []).append((int(s), at))
    assert {k[1]: sorted(v) for k, v in got.items()} == maximal(strings, span) and len(got) == len(maximal(strings, span))


def test_repeats_keep_text_and_empty_table(documents):
    rows = [(1, prose(1, 30)), (2, "head " + prose(1, 30) + " tail")]
    got = {r.doc_id: bytes(r.kept) for r in repeats.without_repeats(documents(rows), keep_text=True).collect()}
    assert got == {1: rows[0][1].encode(), 2: b"head  tail"} or got[1] == rows[0][1].encode() and len(got[2]) < 15
    assert repeats.without_repeats(documents([])).count() == 0
    assert [r.n_removed for r in repeats.without_repeats(documents([(1, "short"), (2, "short"), (3, None)])).collect()] == [0, 0, 0]
    with pytest.raises(ValueError):
        repeats.without_repeats(documents(rows), span=20)


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :]) or a == b


def brute_lines(rows, least=20):
    first = {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for k, line in enumerate((text or "").split("\n")):
            if len(line) >= least:
                first.setdefault(line, ((i is None, i or 0), k, line))
    out = []
    for i, text in rows:
        parts, seen, kept = (text or "").split("\n"), set(), []
        for line in parts:
            if len(line) >= least:
                own = first[line]
                if own[0] != (i is None, i or 0) or line in seen or any(o < own and within_one(line, other) for other, o in first.items() if other != line):
                    continue
                seen.add(line)
            kept.append(line)
        out.append((i, None if text is None else "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=str)


def test_lines_match_brute_force(documents):
    a = "A common footer line of this site, 2023"
    rows = [
        (1, a + "\nshort\n" + prose(1, 10)), (2, a.replace("2023", "2024") + "\nshort\n" + prose(2, 10)), (3, a + "!" + "\n" + a), (4, a[1:] + "\n" + prose(1, 10)[:-2]),
        (5, ""), (6, None), (7, prose(1, 10) + "\n" + prose(1, 10)), (8, "é" * 25 + "\n" + "é" * 24 + "\n" + "é" * 12 + "x" + "é" * 12), (None, a + "\nonly here, in a null document"),
        (9, "x" * 3000 + "\n" + "x" * 2999), (10, "The same line with an error here\nThe same line with an eror here\nthe same line with an eror here"),
    ]
    got = lines.deduplicate(documents(rows, n_lines=7, id=1, _of=1, row=2, own=3, _kept=4)).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=str) == brute_lines(rows)


def test_lines_of_random_edits(documents):
    r = random.Random(9)
    base = [prose(40 + i, 6) for i in range(12)]

    def edited(line):
        p = r.randrange(len(line))
        return r.choice([line, line[:p] + line[p + 1 :], line[:p] + "q" + line[p:], line[:p] + "q" + line[p + 1 :]])

    rows = [(i, "\n".join(edited(r.choice(base)) for _ in range(4))) for i in range(40)]
    got = lines.deduplicate(documents(rows)).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=str) == brute_lines(rows)


def test_lines_of_a_hot_doc_id_stay_with_their_rows(documents, monkeypatch):
    rows = [(None, prose(600 + i, 6) + "\n" + prose(700 + i % 3, 6)) for i in range(30)] + [(1, prose(600, 6))] + [(2, prose(800, 5))] * 3
    out = lines.deduplicate(documents(rows, id=1))
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str) == brute_lines(rows)
    # each row carries the places of its own kept lines, at most as many as it has lines
    real = lines._rebuilt

    def spy(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            assert all(len(kept.as_py() or ()) <= len(text.as_py().split("\n")) for text, kept in zip(batch[0], batch[1], strict=True))
            yield from real(iter([batch]))

    monkeypatch.setattr(lines, "_rebuilt", spy)
    lines.deduplicate(documents(rows)).collect()


def test_lines_exact_only_and_bounds(documents):
    a = "a line that is long enough to count"
    got = {r.doc_id: r.text for r in lines.deduplicate(documents([(1, a), (2, a + "!"), (3, a)]), edits=0).collect()}
    assert got == {1: a, 2: a + "!", 3: ""}
    assert lines.deduplicate(documents([])).count() == 0
    with pytest.raises(ValueError):
        lines.deduplicate(documents([]), edits=2)
