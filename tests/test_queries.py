"""Every registered query with an SQL twin gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from recollect.queries import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def shown(row):
    return tuple(repr(round(v, 6) if isinstance(v, float) else v) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(shown(r[c] for c in columns) for r in df.collect())
    if name not in SQL:
        assert got
        return
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert got == sorted(shown(r[i] for i in order) for r in cursor.fetchall())
