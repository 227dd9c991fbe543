"""The queries of this subpackage on the smallest tables, against DuckDB where there is SQL."""

import math
from pathlib import Path

import duckdb
import pytest

from mnemospark.llm.oracles import ORACLES
from mnemospark.llm.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if not DATA.exists():
        pytest.skip("no test tables here")
    df = QUERIES[name](spark, str(DATA))
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    if name not in ORACLES:
        return
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    q = con.execute(ORACLES[name])
    columns = [c[0] for c in q.description]
    want = sorted((tuple(map(plain, r)) for r in q.fetchall()), key=str)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=str) == want


def test_columns_fixed():
    assert {"p1_found", "p2_found", "p3_found", "p5_found", "p8_found", "p9_found", "p10_found"} <= QUERIES.keys()
