"""Every registered image query against SQL, and what must hold of those without."""

import os
import subprocess
import sys

import duckdb
import pytest

from mosaicore.oracle import ORACLE_SQL
from mosaicore.queries import QUERIES
from tests.conftest import ROOT, SF


@pytest.fixture(scope="session")
def tables():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    return con


def same(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: str(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, tables, name):
    got, want = QUERIES[name](spark, SF), tables.sql(ORACLE_SQL[name])
    assert same(got.columns, got.collect()) == same(list(want.columns), want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_without_sql(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
    if name == "max_domains":
        assert len(rows) == 7 * 20 and {r.dom for r in rows} == set(range(20))
    if name == "encode_decode_e2e":
        assert all(r.psnr > 12 for r in rows)


def test_entry_without_the_optional_subpackage(tmp_path):
    """The registration must work when the training-data operators are not there."""
    for name in ("mosaicore", "__spark_entry__.py"):
        os.symlink(ROOT / name, tmp_path / name) if name.endswith(".py") else subprocess.run(["cp", "-r", ROOT / name, tmp_path / name], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "mosaicore" / "llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'best_match_identity' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
