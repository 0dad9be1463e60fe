"""Compares a query with its SQL on the smallest test tables."""

import os

DATA = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return str(v)


def same_rows(spark, query, sql):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    df = query(spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(_plain, r)) for r in df.select(*columns).collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(_plain(r[i]) for i in at) for r in result.fetchall())
