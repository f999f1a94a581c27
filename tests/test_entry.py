"""The entry module, with and without the optional subpackage; every query with SQL against DuckDB on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from noveltide.plans import catalog

ROOT, SF = Path(__file__).resolve().parent.parent, "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "mean_score" in df.columns


def test_works_without_the_subpackage(tmp_path):
    for name in ("noveltide", "__spark_entry__.py", "bench.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "noveltide/llm", ignore_errors=True)
    code = "import __spark_entry__ as e, bench; q = e.queries(); assert 'pipeline' not in q and not any(x.startswith('op1') for x in q) and len(q) > 50 and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_nothing_outside_imports_the_subpackage():
    for f in (ROOT / "noveltide").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr([value(x) for x in v]) if isinstance(v, list) else repr(v)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    r = tables.execute(catalog.ORACLE_SQL[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted([value(x[cols.index(c)]) for c in sorted(cols)] for x in r.fetchall())
    assert sorted([value(x[c]) for c in sorted(cols)] for x in df.collect()) == want
