"""The entry points, with and without the optional modules, and every query against its SQL."""

import glob
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quillstone.plans import catalog

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or v is pd.NA or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_modules(tmp_path):
    (tmp_path / "quillstone").mkdir()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    for p in (ROOT / "quillstone").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "quillstone" / p.name).symlink_to(p)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.split() == [str(len(catalog.QUERIES)), "False"], out.stderr
