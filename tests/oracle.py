"""Comparison of a Spark result with DuckDB's, as the driver does it: columns by name, rows in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or isinstance(x, float) and x != x or str(x) in ("NaT", "<NA>"):
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return f"{x:.6g}" if x != int(x) else str(int(x))
    return str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(cell(x) for x in r) for r in frame.itertuples(index=False))


def duck(sf, sql):
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        return c.execute(sql).fetchdf()


def check(spark, sf, query, sql):
    got, want = query(spark, sf).toPandas(), duck(sf, sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    return got
