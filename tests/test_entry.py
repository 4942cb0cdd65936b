"""The entry module: every query has the schema its SQL tells, and the rest works without the corpus part."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from faturaflow import queries as fiscal

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = [sorted(map(str, x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False, name=None))) for x in (a, b)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("name", sorted(fiscal.QUERIES))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = fiscal.QUERIES[name](spark, SF).toPandas(), con.execute(fiscal.SQL[name]).df()
    for c in got.columns:
        if got[c].dtype != want[c].dtype and got[c].dtype.kind in "if" and want[c].dtype.kind in "if":
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    same(got, want)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", ["corpus_pipeline.py", "nothing"])
def test_works_without_the_corpus_part(tmp_path, gone):
    """Without the subpackage, whether its pipeline module is still there or not."""
    root = Path(__file__).resolve().parents[1]
    for p in root.iterdir():
        if p.name not in (gone, "faturaflow", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "faturaflow").mkdir()
    for p in (root / "faturaflow").iterdir():
        if p.name != "llm":
            (tmp_path / "faturaflow" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, timeout=100)
    assert out.stdout.split() == [str(len(fiscal.QUERIES)), "False"]
