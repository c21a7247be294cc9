"""Each query beside its SQL, and that the library stands without its optional part."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from quadrat.plans import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return round(float(v), 6) if isinstance(v, int | float) or type(v).__module__ == "numpy" or type(v).__name__ == "Decimal" else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in catalogue.ORACLE_SQL:
        want = duck.execute(catalogue.ORACLE_SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(df.columns) == sorted(columns)
        assert got == rows(columns, want.fetchall())


@pytest.mark.parametrize("pipeline", [False, True])
def test_without_the_optional_part(tmp_path, pipeline):
    """A copy without the corpus folders imports, with or without the pipeline's file, and runs its other queries."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{repo}/quadrat", tmp_path / "quadrat", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
        shutil.copy(f"{repo}/{name}", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tally_by_year' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); print(len(q), len(e.oracle_sql()))"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
