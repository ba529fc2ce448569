"""Every query on training text with SQL gives what DuckDB gives, over whole tables."""

import decimal
import glob
import os

import pytest

from loomsieve.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v


@pytest.mark.parametrize("name", sorted(n for n in queries.oracle_sql() if not n.endswith("_checks")))
def test_query_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(queries.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols)) for r in found.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect()) == want
