"""Every registered query of the engine against its SQL in DuckDB; and the engine without the training-data subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from inkwell import queries

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(None if x is None or x is pd.NA or x != x else f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False)), key=str)


def compare(spark, name: str, query, sql: str, sf: str) -> None:
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = query(spark, sf).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name: str) -> None:
    compare(spark, name, queries.queries()[name], queries.oracle_sql()[name], SF)


def test_others_run(spark) -> None:
    for name in set(queries.queries()) - set(queries.oracle_sql()):
        assert queries.queries()[name](spark, SF).count() > 0


def test_without_the_subpackage(tmp_path) -> None:
    """The entry module still imports and lists the engine's queries."""
    shutil.copytree(ROOT / "inkwell", tmp_path / "inkwell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'term_bm25' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
