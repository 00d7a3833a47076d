"""Every registered query of the core against its SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

from strandloom.plans.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="the tables aren't there")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = sorted("|".join(plain(r[c]) for c in columns) for r in df.collect())
    if name in SQL:
        result = duck.sql(SQL[name])
        assert sorted(result.columns) == columns
        at = [result.columns.index(c) for c in columns]
        assert rows == sorted("|".join(plain(r[i]) for i in at) for r in result.fetchall())
    else:
        assert rows
