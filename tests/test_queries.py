"""Every query with an oracle against DuckDB; every other runs and is not empty."""

import os

import duckdb
import pytest

from tessera import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{os.path.join(SF, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    res = duck.execute(sql)
    names = [c[0] for c in res.description]
    order = [names.index(c) for c in sorted(df.columns)]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(r[i] for i in order) for r in res.fetchall()]
    key = lambda r: tuple((v is None, str(type(v) is str), v if v is not None else 0) for v in r)
    got, want = sorted(rows, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and y is not None and abs(float(x) - float(y)) <= 1e-9 * max(1, abs(float(y)))) for x, y in zip(a, b)), (a, b)
