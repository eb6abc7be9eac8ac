"""Every registered query of the library's own operators against its SQL in DuckDB."""

import math
import numbers
import os

import duckdb
import pytest

from lodestone import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{float(v):.6g}" if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLE_SQL:
        assert got.count() > 0
        return
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
