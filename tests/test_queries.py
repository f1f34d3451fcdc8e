"""Every registered query runs on the smallest data; those with SQL give what DuckDB gives."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tarnflow.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")


def norm(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    if sql := catalog.oracle_sql().get(name):
        rel = con.execute(sql)
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        assert got == sorted(repr(tuple(norm(r[names.index(c)]) for c in cols)) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
