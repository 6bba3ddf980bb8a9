"""Phrases, the manifest and toxicity against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone.llm import manifest, phrases, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_collocations(rows, least=30, share=80, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    over = Counter()
    for (lang, p), v in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                over[lang, p[i : i + k]] = max(over[lang, p[i : i + k]], v)
    out = {}
    for (lang, p), a in found.items():
        if 100 * over[lang, p] < share * a:
            score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return [(lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, v in out.items() for i, (s, a, p, x, y) in enumerate(sorted(v)[:top], 1)]


def texts_of(n, seed=1):
    r = np.random.default_rng(seed)
    vocabulary = ["the", "The", "new", "york", "NEW York", "été", "ÉTÉ", "x\x00y", "a b", "\U0001f600", "ﬁ", "stock", "exchange", "rate"]
    ends = [" ", "  ", "\t", " \t ", ". ", ",", "\n", "\r\n", "\x0b", "\x0c", "! ", ";", "?", ":"]
    return ["".join(str(r.choice(vocabulary)) + str(r.choice(ends, p=[0.5, 0.1, 0.05, 0.05] + [0.03] * 10)) for _ in range(int(r.integers(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("cut", [0, 54])  # with ten bits left, nearly all fingerprints collide
@pytest.mark.parametrize("window", [1 << 22, 50])
def test_collocations(spark, monkeypatch, cut, window):
    monkeypatch.setattr(phrases, "WINDOW", window)
    rows = [(i % 3 and ("en", "de")[i % 2] or None, t) for i, t in enumerate(texts_of(200))]
    rows += [("und", "stock exchange rate " * 40), ("en", None), (None, ""), ("fr", "only once"), ("en", " \t ... \n")]
    rows += [("es", "Copia exacta, de todo")] * 31
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(1) for c in ("seed", "n", "f", "score", "k1", "Start", "phrase")})
    got = [tuple(r) for r in phrases.collocations(docs, least=8, top=40, cut=cut).collect()]
    assert sorted(got) == sorted(plain_collocations(rows, 8, top=40)) and {"und", "en", "de", "es"} <= {r[0] for r in got}


def test_collocations_of_long_texts_and_words(spark, monkeypatch):
    monkeypatch.setattr(phrases, "WINDOW", 1 << 12)
    word = "w" * 100_000
    rows = [("en", f"{word} {word}x " * 31 + "a b c " * 30_000), ("en", f"{word} {word}x"), ("de", "a a a a a " * 400)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(tuple(r) for r in phrases.collocations(docs).collect())
    assert got == sorted(plain_collocations(rows)) and any(word in r[2] for r in got)
    assert phrases.collocations(docs.limit(0)).count() == 0 and phrases.collocations(spark.createDataFrame([("en", None)], "lang string, text string")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    rows = [("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big // 3), ("en", 1, "c", big), ("en", 2, "b c", 10), ("en", 3, "a b c", big // 3 * 8 // 10 - 1)]
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in phrases.scored(spark.createDataFrame(rows, "lang string, n int, phrase string, f long")).collect()}
    assert got["a b"] == (big // 3, big, big - 1, 2_000_000 * (big // 3) // (2 * big - 1))
    assert "b c" not in got and got["a b c"][3] == min(2_000_000 * (big // 3 * 8 // 10 - 1) // (big + 10), 2_000_000 * (big // 3 * 8 // 10 - 1) // (big // 3 + big))


def test_a_full_bit_table_loses_nothing(spark, monkeypatch):
    small = phrases.bit_table
    monkeypatch.setattr(phrases, "bit_table", lambda prints: small(prints, 8))
    rows = [("en", t) for t in texts_of(120, 5)]
    got = [tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least=5).collect()]
    assert sorted(got) == sorted(plain_collocations(rows, 5))


def test_words_of_equal_fingerprints_are_told_apart(spark):
    bits = [i.bit_count() & 1 for i in range(4096)]  # Thue-Morse: polynomials over 64 bits are equal for both
    one, two = ("".join(letters[b] for b in bits) for letters in ("ab", "ba"))
    assert len({int(phrases._slices(phrases._VALUES[np.frombuffer(w.encode(), np.uint8)], np.array([0]), np.array([4096]))[0]) for w in (one, two)}) == 1
    rows = [("en", f"x {one} y. " * 20 + f"x {two} y. " * 15)] * 2
    got = [tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "lang string, text string")).collect()]
    assert sorted(got) == sorted(plain_collocations(rows)) and {40, 30} == {r[3] for r in got}


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = context.statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_counts_of_pairs_are_shuffled_in_few_bytes(spark):
    r = np.random.default_rng(7)
    rows = [("en", " ".join(f"w{x}" for x in r.integers(0, 2000, 1500))) for _ in range(200)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    before = shuffled(spark)
    assert phrases.collocations(docs).count() == 0
    pairs = len({(a, b) for _, t in rows for a, b in zip(t.split(), t.split()[1:])})
    assert shuffled(spark) - before < 6 * pairs


def test_blocks_keep_what_they_hold():
    r = np.random.default_rng(3)
    keys = r.integers(0, 1 << 63, 3000).astype(np.uint64) << np.uint64(1)
    keys[:2000] = keys[2000:2020].repeat(100)  # among them keys that differ only in the second
    columns = [keys, r.integers(0, 3, 3000).astype(np.uint32), r.integers(1, 1 << 40, 3000), r.integers(0, 256, 3000).astype(np.uint8)]
    want = pd.DataFrame(dict(zip("abcd", columns, strict=True))).groupby(["a", "b"], as_index=False).agg({"c": "sum", "d": "min"})
    held = phrases.Blocks(2, 64, 8, most=500)
    found = [b for at in range(0, 3000, 100) for b in held.take([x[at : at + 100] for x in columns])] + [*held.rest()]
    parts = [phrases.unpacked(b["block"], b["size"], phrases.EXACT) for x in found for b in x.to_pylist()]
    assert all((phrases.unpacked(b["block"], b["size"], phrases.EXACT)[0] >> np.uint64(56) == b["bucket"]).all() for x in found for b in x.to_pylist())
    got = phrases._summed([np.concatenate(x) for x in zip(*parts, strict=True)], 2)
    assert [x.tolist() for x in got] == [want[c].tolist() for c in "abcd"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, arity=8):
    def leaf(r):
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])))

    def up(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + arity] for i in range(0, len(nodes), arity)]
            for j, path in enumerate(paths):
                path.append((at[j] % arity, runs[at[j] // arity]))
                at[j] //= arity
            nodes = [digest(*run) for run in runs]
        return nodes[0], paths

    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    made = [(sorted(trees[k], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))) for k in sorted(trees, key=lambda k: (k is not None, (k or "").encode()))]
    built = [(t, *up([leaf(r) for r in t])) for t in made]
    root, over = up([sub for _, sub, _ in built]) if built else (None, [])
    out = []
    for (tree, sub, own), rest in zip(built, over, strict=True):
        for r, path in zip(tree, own, strict=True):
            copy = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                copy["text"] = r["text"].translate(LOWER)
            node, path = leaf(copy), path + rest
            for slot, kids in path:
                node = digest(*kids[:slot], node, *kids[slot + 1 :])
            out.append((r["doc_id"], leaf(r), sub, root, digest(*(k for slot, kids in path for i, k in enumerate(kids) if i != slot)), node, node == root))
    return out


@pytest.mark.parametrize("n, langs", [(0, 1), (1, 1), (2, 1), (8, 1), (9, 1), (65, 2), (530, 3), (90, 40)])
def test_manifest(spark, n, langs):
    rows = [{"doc_id": i if i % 50 else None, "source": f"S{i % 3}" if i % 7 else None, "lang": f"l{i % langs}é" if i % langs else None, "n_chars": i if i % 5 else None, "text": f"Some Text {i} ÄÖ" if i % 11 else None} for i in range(n)]
    rows += rows[20:30] * 2 + ([{**rows[0], "doc_id": 7, "text": "", "lang": "alone"}, {**rows[0], "doc_id": -3, "text": "B" * 300_000}] if n > 8 else [])
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    docs = docs.withColumns({c: F.lit("clash") for c in ("tree", "at", "total", "digest", "Leaf", "root", "tail")})
    got = manifest.checked(docs.repartition(5)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_manifest(rows)))


def test_toxicity(spark, documents):
    fine = [(i, f"The plain sentence number {i} reads well, and so does the next one about {i % 9} things.") for i in range(300)]
    bad = [(1000 + i, f"The plain sentence number {i} reads, you {('blorp', 'Snarg', 'FROB')[i % 3]} idle thing {i % 9}.") for i in range(150)]
    docs = documents(fine + bad + [(5000, ""), (5001, None), (None, "you blorp"), (5002, "well " * 200_000 + "you snarg idle thing")], score="clash", hashes=1, label="x")
    labels = spark.createDataFrame([(i, 0) for i, _ in fine] + [(i, 1) for i, _ in bad] + [(None, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity.judged(docs, labels).collect()
    assert len(got) == 454 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.held_out} == {r.doc_id for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    held = [r for r in got if r.held_out and r.doc_id < 5000]
    assert len(held) > 100 and np.mean([r.predicted == (r.doc_id >= 1000) for r in held]) > 0.97
    by = {r.doc_id: r.score for r in got}
    assert by[5000] == by[5001] < 0.7 and by[None] > 0.5 and by[5002] > 0.5
    assert toxicity.fit(docs, labels.limit(0)) is None and {r.score for r in toxicity.judged(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.judged(documents([]), labels).count() == 0
    assert sorted(map(str, toxicity.judged(docs.repartition(5), labels).collect())) == sorted(map(str, got))


def test_toxicity_learns_and_scores_like_a_plain_version(spark, documents):
    r = np.random.default_rng(2)
    data = [(i, i % 2, [*r.integers(-(2**31), 2**31, 12).tolist(), 7 + i % 2, 7 + i % 2]) for i in range(80)]
    s, bits = toxicity.Follow(l1=0.4), 12
    got = toxicity.train(pd.DataFrame(data, columns=["order", "label", "hashes"]), s, 2, bits)
    z, n = {}, {}

    def weight(k):
        zk, nk = z.get(k, 0.0), n.get(k, 0.0)
        return 0.0 if abs(zk) <= s.l1 else -(zk - (1 if zk > 0 else -1) * s.l1) / ((s.beta + nk**0.5) / s.alpha + s.l2)

    for _ in range(2):
        for _, label, hashes in data:
            x = {*toxicity.features(np.array(hashes), bits).tolist(), -1}
            g = (1 / (1 + np.exp(-sum(map(weight, x)))) - label) * (s.rare if label else 1)
            for k, w in [(k, weight(k)) for k in x]:
                old = n.get(k, 0.0)
                z[k], n[k] = z.get(k, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / s.alpha * w, old + g * g
    assert dict(zip(got["bucket"], got["weight"], strict=True)) == pytest.approx({k: weight(k) for k in z if weight(k)}, abs=1e-9)
    texts = [(1, "One two, TWO three! one"), (2, ""), (3, None), (4, "word " * 100_000 + "Ünï 12")]
    hashed = {x.doc_id: x.h for x in documents(texts).select("doc_id", toxicity.token_hashes(F.col("text")).alias("h")).collect()}
    assert len(hashed[1]) == 5 and hashed[1][1] == hashed[1][2] and hashed[1][0] == hashed[1][4]
    used = sorted({b for h in hashed.values() for b in toxicity.features(np.array(h, np.int32)).tolist()})
    model = pd.DataFrame({"bucket": [-1, *used[::2]], "weight": r.normal(size=1 + len(used[::2]))})
    known = dict(zip(model["bucket"], model["weight"], strict=True))
    for row in toxicity.score(documents(texts), model).collect():
        plain = known[-1] + sum(known.get(b, 0.0) for b in set(toxicity.features(np.array(hashed[row.doc_id], np.int32)).tolist()))
        assert row.score == pytest.approx(1 / (1 + np.exp(-plain)), rel=1e-9)


def test_toxicity_on_the_given_tables(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.judged(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels).join(labels, "doc_id").filter("held_out AND toxic IS NOT NULL").toPandas()
    bad, fine = rows[rows["toxic"] == 1]["score"].to_numpy(), rows[rows["toxic"] == 0]["score"].to_numpy()
    assert (bad[:, None] > fine).mean() > 0.75 and (fine < 0.7).mean() > 0.98
