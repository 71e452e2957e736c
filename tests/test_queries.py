"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import math

import pytest

duckdb = pytest.importorskip("duckdb")

from mnemora.plans.registry import ORACLE_SQL, QUERIES  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    return repr(float(x)) if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else repr(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, db, name):
    got = QUERIES[name](spark, small)
    data = got.collect()
    if name not in ORACLE_SQL:
        assert got.columns
        return
    ref = db.execute(ORACLE_SQL[name])
    names = [c[0] for c in ref.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, data) == rows(names, ref.fetchall())


def test_entry_imports_without_training_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "mnemora", tmp_path / "mnemora", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(k.startswith('op') or k == 'pipeline' for k in q), len(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True)
