"""A query's rows beside those of its SQL."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def same(frame, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted(repr(tuple(plain(v) for v in row)) for row in result.fetchall())
    got = sorted(repr(tuple(plain(v) for v in row)) for row in frame.select(*names).collect())
    assert got == want
