"""Every query of the core that has SQL must agree with it on the small tables."""

import math
import os

import duckdb
import pytest

from colloquy.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def norm(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}".replace("-0.000000", "0.000000")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*columns).collect())
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
