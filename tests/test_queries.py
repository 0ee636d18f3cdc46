"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from loomfill.plans.oracle import ORACLE_SQL
from loomfill.plans.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    return c


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, abs_tol=1.5e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    if name not in ORACLE_SQL:
        assert df.count() > 0
        return
    names = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(*names).collect()]
    order = lambda r: tuple((x is None, round(x, 3) if isinstance(x, float) else x) for x in r)
    got.sort(key=order)
    want.sort(key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(map(same, a, b)), (a, b)


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
