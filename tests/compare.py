"""Spark rows against DuckDB rows, order and column order aside."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, list | tuple):
        return tuple(map(norm, v))
    return v if v is None or not hasattr(v, "as_tuple") else f"{float(v):.9g}"


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def assert_same(df, sql: str, db: duckdb.DuckDBPyConnection) -> None:
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    out = db.sql(sql)
    assert sorted(out.columns) == cols
    at = [out.columns.index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in out.fetchall()), key=repr)
