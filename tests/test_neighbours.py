"""Nearest vectors over pivots: equal to scoring all pairs, and fewer pairs are scored where vectors lie in groups."""

import numpy as np
import pytest

from quillstone.operators import neighbours, retrieve


def vectors(spark, rows, name="chunk_id"):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v]) for i, v in rows], f"{name} long, v array<double>")


def grouped(seed=1, groups=40, each=40, dims=32):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(groups, dims))
    return np.repeat(middle, each, axis=0) + 0.1 * r.normal(size=(groups * each, dims))


def found(df):
    return sorted(tuple(r) for r in df.select("qid", "chunk_id", "score", "rank").collect())


def same(spark, rows, asked, k=5, pivots=16):
    v, q = vectors(spark, rows), vectors(spark, asked, "qid")
    assert found(neighbours.nearest(q, neighbours.place(v, pivots=pivots), k)) == found(retrieve.cosine(q, v, k))


def test_groups_are_skipped(spark, monkeypatch):
    passes, scores = [], neighbours._scores

    def recorded(*args):
        passes.append(scores(*args))
        return passes[-1]

    monkeypatch.setattr(neighbours, "_scores", recorded)
    v = grouped()
    same(spark, enumerate(v), [(i, v[i * 50] * 3) for i in range(30)], pivots=40)
    assert len(passes) == 2 and sum(p.count() for p in passes) < 0.2 * 30 * len(v)


def test_random_and_repeated_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 7)
    monkeypatch.setattr(neighbours, "QUESTION_BLOCK", 2)
    v = np.random.default_rng(2).normal(size=(200, 8)).round(1)
    rows = [*enumerate(v), *((1000 + i, v[3]) for i in range(40)), *((2000 + i, -v[i]) for i in range(10))]
    same(spark, rows, [(i, v[i]) for i in range(8)], k=12)


@pytest.mark.parametrize("pivots", [1, 3])
def test_few_pivots_and_few_vectors(spark, pivots):
    v = np.random.default_rng(3).normal(size=(4, 3))
    same(spark, enumerate(v), [(0, v[0]), (1, -v[1])], k=10, pivots=pivots)


def test_what_has_no_cosine(spark):
    rows = [(0, [1, 0]), (1, [0, 0]), (2, None), (3, [float("nan"), 1]), (4, [float("inf"), 1]), (5, [1, 1])]
    placed = neighbours.place(vectors(spark, rows))
    asked = vectors(spark, [(0, [1, 0]), (1, None), (2, [0, 0]), (3, [float("nan"), 0])], "qid")
    assert found(neighbours.nearest(asked, placed, 5)) == [(0, 0, 1.0, 1), (0, 5, 0.707107, 2)]


def test_nothing(spark):
    some, none = vectors(spark, [(0, [1, 0])]), vectors(spark, [])
    q, q0 = some.withColumnRenamed("chunk_id", "qid"), none.withColumnRenamed("chunk_id", "qid")
    assert found(neighbours.nearest(q, neighbours.place(none))) == []
    assert found(neighbours.nearest(q0, neighbours.place(some))) == []


def test_filters_come_first_and_written_units_are_read(spark, tmp_path):
    v = grouped(5, groups=10, each=20, dims=8)
    all_of, q = vectors(spark, enumerate(v)), vectors(spark, [(i, v[i]) for i in range(6)], "qid")
    neighbours.place(all_of, pivots=10).write(str(tmp_path / "placed"))
    placed = neighbours.Placed.read(spark, str(tmp_path / "placed"))
    odd = placed._replace(units=placed.units.filter("chunk_id % 2 = 1"))
    assert found(neighbours.nearest(q, odd, 15)) == found(retrieve.cosine(q, all_of.filter("chunk_id % 2 = 1"), 15))
