"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from colguard.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def norm(row):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((norm(r) for r in df.select(*cols).collect()), key=str)
    if name in SQL:
        want = con.execute(SQL[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == cols
        assert got == sorted((norm(tuple(r[names.index(c)] for c in cols)) for r in want.fetchall()), key=str)
    else:
        assert got
