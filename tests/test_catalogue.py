"""Every query that has SQL against DuckDB on the smallest tables; the library without its subpackage for training data."""

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from mnemospark.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[1]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    if not DATA.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_duckdb(spark, duck, name):
    q = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in q.description]
    want = sorted((tuple(map(plain, r)) for r in q.fetchall()), key=str)
    df = catalogue.QUERIES[name](spark, str(DATA))
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=str) == want


def test_works_without_the_subpackage(tmp_path):
    code = "import sys; sys.modules['mnemospark.llm'] = None; import __spark_entry__ as e; assert not [q for q in e.queries() if q[:3] in ('p1_', 'p2_')]; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=100)
    assert out.returncode == 0, out.stderr
    text = "".join(p.read_text() for p in (ROOT / "mnemospark").rglob("*.py") if "llm" not in p.parts)
    assert "llm" not in text
