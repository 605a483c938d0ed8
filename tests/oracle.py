"""Compare a query with its SQL over the same Parquet tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def normal(rows):
    def cell(v):
        return "null" if v is None else repr(round(v, 9)) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


def assert_same(df, sql, sf_dir):
    names = sorted(df.columns)
    got = normal(tuple(r[n] for n in names) for r in df.collect())
    cursor = connection(sf_dir).execute(sql)
    have = [d[0] for d in cursor.description]
    assert sorted(have) == names
    at = [have.index(n) for n in names]
    assert got == normal(tuple(r[i] for i in at) for r in cursor.fetchall())
