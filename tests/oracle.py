"""Compare a query with its SQL in DuckDB on the given tables."""

import math

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str = SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _text(v):
    return "null" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v)


def assert_same(con, df, sql: str) -> None:
    cols = sorted(df.columns)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(_text(r[names.index(c)]) for c in cols) for r in result.fetchall())
    ours = sorted(tuple(_text(r[c]) for c in cols) for r in df.collect())
    assert ours == theirs
