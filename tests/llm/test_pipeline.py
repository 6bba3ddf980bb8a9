"""The pipeline's stages on a small corpus, its run, and the registered queries against SQL."""

import glob
import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm import copies, queries, simhash

SF = "/root/testdata/sf0.001"
ORDER = ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixture"]
STAGES = dict(corpus_pipeline.STAGES)


def prose(seed, n=80):
    r = random.Random(seed)
    return " ".join(r.choice("the of and plain river stone house walks under light before morning".split()) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with tables: documents good and bad, a benchmark and labels."""
    d = str(tmp_path_factory.mktemp("tables"))
    item = prose(777, 30)
    rows = [(i, prose(i), f"s{i % 3}") for i in range(120)] + [(200 + i, " ".join(f"W{i + j}!!" for j in range(60)), "s1") for i in range(60)]
    rows += [(300, prose(3), "s0"), (301, prose(4) + " end", "s0"), (302, prose(901) + " " + item, "s2"), (303, prose(902, 40) + "\n" + prose(5), "s2"), (304, "", None), (305, None, "s1"), (306, prose(906), None), (306, prose(906), None)]
    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in [*range(120), *range(200, 260)]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ORDER


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("size", F.lit("clash"))
    ids = lambda df: sorted((r.doc_id for r in df.collect() if r.doc_id is not None))
    good = STAGES["quality_classifier"](spark, docs, folder)
    assert good.columns == docs.columns
    assert set(range(120)) <= set(ids(good)) and not set(range(200, 260)) & set(ids(good))
    lines = STAGES["line_dedup"](spark, docs, folder)
    assert lines.columns == docs.columns
    by = {r.doc_id: r for r in lines.collect()}
    assert 300 not in by and by[303].text == prose(902, 40) and by[303].n_chars == len(by[303].text) and by[304].text == "" and by[305].text is None
    assert by[0].text == prose(0) and sum(r.doc_id == 306 for r in lines.collect()) == 2
    near = STAGES["simhash_near_dedup"](spark, docs, folder)
    assert near.columns == docs.columns and not {300, 301} & set(ids(near)) and {3, 4, 304} <= set(ids(near)) and set(range(120)) <= set(ids(near))
    clean = STAGES["benchmark_decontamination"](spark, docs, folder)
    assert clean.columns == docs.columns and set(ids(docs)) - set(ids(clean)) == {302}
    mixed = STAGES["source_mixture"](spark, docs, folder)
    taken = mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 80 for r in taken if r.g)


def jaccard(a, b, width=5):
    x, y = ({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for w in ((a or "").lower().split(), (b or "").lower().split()))
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("part", [1024, 4])
def test_near_dedup_goes_by_shingles(spark, monkeypatch, part):
    r = random.Random(4)
    rows = []
    for i in range(60):
        words = prose(5000 + i, 120).split(" ")
        rows.append((10 * i, " ".join(words)))
        for k in range(1, 4):
            for at in r.sample(range(120), r.randrange(1, 5)):
                words[at] = f"new{i}x{k}x{at}"
            rows.append((10 * i + k, " ".join(words)))
    rows += [(700, "a b c"), (701, "A  b\tc"), (702, "a b"), (703, ""), (704, None), (None, prose(5000, 120)), (None, prose(8000, 120)), (None, prose(8000, 120) + " end")]
    group = list(range(len(rows)))
    near = [(a, b) for a in range(len(rows)) for b in range(a) if jaccard(rows[a][1], rows[b][1]) >= 0.8]
    assert sum(jaccard(rows[a][1], rows[b][1]) < 0.9 for a, b in near) > 30
    for _ in range(8):
        for a, b in near:
            group[a] = group[b] = min(group[a], group[b])
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    want = [r for r, g in zip(rows, group, strict=True) if least[g] is None or r[0] == least[g]]
    monkeypatch.setattr(copies, "PART", part)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("node", "gone", "_of", "_text", "text_id")})
    got = STAGES["simhash_near_dedup"](spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_stages_on_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    ids = [r.doc_id for r in out]
    assert out and set(ids) <= {*range(120), 301, 303, 304, 306} and all(r.copies >= 1 for r in out)


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or v is pd.NA or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(queries.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    source = "pages" if name.startswith("op2") else "documents"
    assert got.count() == spark.read.parquet(f"{SF}/{source}.parquet").count()


def test_near_dedup_takes_candidates_from_simhash(spark):
    """Without a MinHash band the pairs that SimHash gives are compared, and those that are alike are linked."""
    text = prose(1, 300)
    rows = [(0, text), (1, text.rsplit(" ", 1)[0]), (2, prose(2, 300))]
    assert (simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])).bit_count() <= simhash.RADIUS
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    each = spark.createDataFrame([(i, 0, int(np.array([simhash.fingerprint(t)], np.uint64).view(np.int64)[0])) for i, t in rows], "k1 long, k2 long, print long")
    nodes = docs.select(F.col("doc_id").alias("k1"), F.lit(0).cast("long").alias("k2"), F.col("doc_id").alias("node"), copies._text_id(docs).alias("text_id"), F.array().cast("array<long>").alias("least_hashes"))
    near = copies._simhash_pairs(each, nodes, simhash.RADIUS)
    assert [tuple(r) for r in near.collect()] == [(0, 1)]
    none = nodes.select("node", F.lit(0).cast("long").alias("key")).limit(0)
    assert {(r.node, r.root) for r in copies._links(docs, nodes, none, near, copies.WIDTH, copies.SHARE).collect()} == {(0, 0), (1, 0)}
