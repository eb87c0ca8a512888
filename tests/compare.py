"""Compare a query with its SQL in DuckDB."""

import os

import duckdb


def _cell(v):
    if v is None or (isinstance(v, float) and v != v):
        return "None"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if hasattr(v, "tolist"):
        v = v.tolist()
    return "None" if str(v) in ("<NA>", "NaT") else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(_cell(v) for v in r) for r in df.itertuples(index=False, name=None))


def tables(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in os.listdir(sf):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    return c


def same(spark, sf, query, sql):
    got, want = query(spark, sf).toPandas(), tables(sf).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
