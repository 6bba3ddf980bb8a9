"""The index of segments: equal to an index built anew after every change, and reading no more than it must."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import index, retrieve, segments

WORDS = ["revenue", "cost", "capital", "net", "sales", "income", "tax", "segment", "cash", "flow"]


def units(spark, n, start=0):
    rows = [(f"c{i:03}", " ".join(WORDS[(i * j + j) % 10] for j in range(1, 4 + i % 17)) + (" rare" if i == 17 else ""), f"T{i % 5}", "10-K", f"20{10 + i % 10}-01-01") for i in range(start, n)]
    return spark.createDataFrame(rows, "chunk_id string, text string, ticker string, form string, filed string")


def asked(spark):
    return spark.createDataFrame([(1, "revenue"), (1, "rare"), (2, "cash"), (2, "flow"), (2, "tax"), (3, "unknown")], "qid int, term string")


def plain(held, terms, k, only=None):
    posted = index.postings(held, stem=False)
    return sorted(map(tuple, retrieve.bm25(terms, posted, *index.statistics(posted, held), k, only=only).collect()))


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(segments, "SLAB", 4)
    monkeypatch.setattr(segments, "FIRST", 1)


def test_every_change_equals_an_index_built_anew(spark, tmp_path):
    path, q = f"{tmp_path}/ix", asked(spark)
    every = units(spark, 120)
    found = lambda k=5: sorted(map(tuple, segments.search(segments.load(spark, path), q, k).collect()))
    segments.add(units(spark, 70), path, stem=False)
    assert found() == plain(units(spark, 70), q, 5)
    segments.add(units(spark, 120, 60), path, stem=False)  # ten of them are held already
    assert found() == plain(every, q, 5)
    gone = [f"c{i:03}" for i in (*range(0, 120, 7), 17)]
    segments.delete(spark.createDataFrame([(g,) for g in gone] + [("unknown",)], "chunk_id string"), path)
    left = every.filter(~F.col("chunk_id").isin(gone))
    assert found() == plain(left, q, 5)
    held = segments.load(spark, path)
    assert (held.n, held.avgdl) == tuple(index.statistics(index.postings(left), left)[1].first())
    segments.delete(spark.createDataFrame([(g,) for g in gone], "chunk_id string"), path)  # again: nothing is left to delete
    assert found() == plain(left, q, 5) and segments.load(spark, path).n == left.count()
    before = segments.versions(spark, path)
    merged = segments.merge(spark, path)
    assert found() == plain(left, q, 5) and segments.load(spark, path).gone is None and segments.load(spark, path).blocks.select("segment").distinct().count() == 1
    assert sorted(map(tuple, segments.search(segments.load(spark, path, before[0]), q, 5).collect())) == plain(units(spark, 70), q, 5)
    removed = segments.forget(spark, path)
    assert segments.versions(spark, path) == [merged] and found() == plain(left, q, 5) and any(x.startswith("deletes/") for x in removed)
    assert segments.forget(spark, path) == []


def test_texts_that_change_and_rows_that_repeat(spark, tmp_path):
    path = f"{tmp_path}/ix"
    schema = "chunk_id string, text string, ticker string, form string, filed string"
    segments.add(spark.createDataFrame([("a", "old words", "T", "10-K", None), ("b", None, None, None, None), ("c", "", "T", "10-K", "x")], schema), path, stem=False)
    segments.add(spark.createDataFrame([("a", "new words", "T", "10-K", None), ("a", "more", "T", "10-K", None)], schema), path, stem=False)
    held = segments.load(spark, path)
    q = spark.createDataFrame([(1, "old"), (2, "new"), (3, "more"), (3, "words")], "qid int, term string")
    assert sorted((r.qid, r.chunk_id) for r in segments.search(held, q).collect()) == [(2, "a"), (3, "a")] and (held.n, held.avgdl) == (3, 1.0)
    with pytest.raises(ValueError):
        segments.add(units(spark, 2), path, stem=True)


def test_filters_come_before_postings(spark, tmp_path):
    path, q = f"{tmp_path}/ix", asked(spark)
    every = units(spark, 120)
    segments.add(every, path, stem=False)
    held = segments.load(spark, path)
    wanted = spark.createDataFrame([(1, "T2", "2012"), (2, "T3", "2019"), (3, "T1", "2010")], "qid int, ticker string, since string")
    only = segments.allowed(held, wanted, F.col("filed") >= F.col("since"))
    keys = every.join(wanted, "ticker").filter("filed >= since").select("qid", "chunk_id")
    assert sorted(map(tuple, segments.search(held, q, 5, only).collect())) == plain(every, q, 5, keys)
    weighted = segments.weighted_terms(held, q)
    all_slabs, few = segments.slab_bounds(held, weighted).count(), segments.slab_bounds(held, weighted, only).count()
    assert few * 2 < all_slabs  # units lie in order of their attributes, so a company is in few slabs
    nothing = spark.createDataFrame([(1, "none"), (2, "T3")], "qid int, ticker string")
    out = segments.search_relaxed(held, q, segments.allowed(held, nothing), 5).collect()
    posted = index.postings(every, stem=False)
    both = every.join(nothing, "ticker").select("qid", "chunk_id")
    want = retrieve.bm25_relaxed(q, posted, *index.statistics(posted, every), both, 5).collect()
    assert sorted((r.qid, r.chunk_id, r.score, r.rank, r.relaxed) for r in out) == sorted((r.qid, r.chunk_id, r.score, r.rank, r.relaxed) for r in want)


def test_slabs_that_cannot_hold_a_best_unit_are_skipped(spark, tmp_path):
    path = f"{tmp_path}/ix"
    rows = [(f"c{i:04}", "common " + ("rare word " * 3 if i % 97 == 5 else "filler " * (i % 30)), "T", "10-K", f"{i:04}") for i in range(1000)]
    every = spark.createDataFrame(rows, "chunk_id string, text string, ticker string, form string, filed string")
    segments.add(every, path, stem=False)
    held = segments.load(spark, path)
    q = spark.createDataFrame([(1, "common"), (1, "rare"), (1, "word")], "qid int, term string")
    weighted = segments.weighted_terms(held, q)
    everywhere, read = segments.slab_bounds(held, weighted).count(), segments.wanted_slabs(held, weighted, 3).count()
    assert everywhere == 250 and read <= 11
    assert sorted(map(tuple, segments.search(held, q, 3).collect())) == plain(every, q, 3)


def test_a_manifest_that_was_not_finished_is_not_read(spark, tmp_path):
    path, q = f"{tmp_path}/ix", asked(spark)
    first = segments.add(units(spark, 20), path, stem=False)
    (tmp_path / "ix" / "manifests" / f"version={first + 1}" / "_temporary").mkdir(parents=True)
    assert segments.versions(spark, path) == [first]
    assert sorted(map(tuple, segments.search(segments.load(spark, path), q, 5).collect())) == plain(units(spark, 20), q, 5)
    assert segments.add(units(spark, 30, 20), path, stem=False) == first + 2
    assert sorted(map(tuple, segments.search(segments.load(spark, path), q, 5).collect())) == plain(units(spark, 30), q, 5)
    with pytest.raises(ValueError):
        segments.load(spark, path, first + 1)
