"""Compare a query with its SQL on the same tables, as the driver does."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def normal(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


def same(df, con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    want = got.fetchall()
    have = [tuple(r[n] for n in names) for r in df.collect()]
    a, b = normal(have), normal(want)
    assert len(a) == len(b), (len(a), len(b), a[:2], b[:2])
    for x, y in zip(a, b):
        assert x == y, (x, y)
