"""Every registered query of the record operators against its SQL in DuckDB."""

import math
from decimal import Decimal

import duckdb
import pytest

from gleaner.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in catalog.oracle_sql():
        return
    cur = con.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
