"""Every registered query of the library against its SQL, and rows only where there is none."""

import collections
import glob
import os

import duckdb
import pytest

from matrixmill.jobs import queries as Q

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_matches_sql(spark, db, name):
    df = Q.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    found = db.execute(Q.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = collections.Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, name):
    df = Q.QUERIES[name](spark, DIR)
    rows = df.collect()
    for r in rows:
        for c in ("p", "significance"):
            if c in df.columns:
                assert 0 <= r[c] <= 1
