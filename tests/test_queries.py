"""Every query of the core that has SQL gives the rows of DuckDB; the others run."""

import decimal
import math
import os

import duckdb
import pytest

from tidegraph import catalog

SLOW = {"exposure_by_type"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - SLOW))
def test_query(name, spark, data, db):
    df = catalog.queries()[name](spark, data)
    rows = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    sql = catalog.oracle_sql().get(name)
    if sql:
        rel = db.sql(sql)
        at = [rel.columns.index(c) for c in sorted(df.columns)]
        assert sorted(rel.columns) == sorted(df.columns)
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    else:
        assert rows
