"""Every query that SQL can express, against DuckDB on the same tables."""

import os

import pytest

from bitempo.queries import ORACLES, Q

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(x):
    return round(float(x), 6) if isinstance(x, float) else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = Q[name](spark, D)
    done = duck.execute(ORACLES[name])
    columns = [c[0] for c in done.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, done.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q) - set(ORACLES)))
def test_runs(spark, name):
    assert Q[name](spark, D).count() > 0
