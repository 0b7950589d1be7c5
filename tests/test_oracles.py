"""Every registered query against its SQL on DuckDB, and the guard around the training-data operators."""

from __future__ import annotations

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from vigilspark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def cells(row):
    return tuple(None if v is None else float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v for v in row)


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, small, duck, name):
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = [cells(r[c] for c in columns) for r in df.collect()]
    rel = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = [cells(r[names.index(c)] for c in columns) for r in rel.fetchall()]
    assert ordered(got) == ordered(want)


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry_imports_without_the_training_data_operators(tmp_path):
    for p in ("__spark_entry__.py", "vigilspark"):
        (tmp_path / p).symlink_to(ROOT / p) if p.endswith(".py") else None
    package = tmp_path / "vigilspark"
    package.mkdir()
    for p in (ROOT / "vigilspark").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (package / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'screen_all' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
