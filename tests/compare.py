"""Holds a query's rows against its SQL on DuckDB."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr), [columns[i] for i in order]


def compare(spark, name, sf_dir):
    import duckdb

    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = con.sql(entry.oracle_sql()[name])
    a, a_names = rows(df.columns, [tuple(r) for r in df.collect()])
    b, b_names = rows(found.columns, found.fetchall())
    assert a_names == b_names
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or isinstance(p, (int, float)) and isinstance(q, (int, float)) and abs(p - q) < 2e-5 for p, q in zip(x, y, strict=True)), (x, y)
