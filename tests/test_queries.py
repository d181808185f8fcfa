"""Every registered query against DuckDB on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from tidemark import registry

FOLDER = os.environ.get("TIDEMARK_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, datetime.datetime):
        return v.isoformat().removesuffix("T00:00:00")
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v if v is None or isinstance(v, (bool, str)) else round(float(v), 5)


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(([plain(r[k]) for k in order] for r in found), key=repr)


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for f in os.listdir(FOLDER):
        made.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return made


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, FOLDER)
    want = con.execute(registry.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert {*entry.oracle_sql()} <= {*entry.queries()}
