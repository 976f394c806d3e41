"""Every query of the catalogue against its SQL in DuckDB, and the entry module without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tallyloom.catalogue import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def told(value):
    """A value as text, the same for both engines."""
    if isinstance(value, float):
        return f"{value:.6g}"
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return str({k: told(v) for k, v in value.items()})
    return str([told(v) for v in value]) if isinstance(value, (list, tuple)) else str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(told(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf, duck, name):
    df, sql = QUERIES[name](spark, sf), duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.columns, df.collect()) == rows(sql.columns, sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_catalogue_loads_without_session_or_subpackage():
    code = "import sys; sys.modules['tallyloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
