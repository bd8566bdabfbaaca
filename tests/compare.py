"""Runs a query and its SQL counterpart over the same tables and compares the rows."""

import math
import os

DATA = os.environ.get("TONELAKE_TESTDATA", "/root/testdata/sf0.001")


def have_data() -> bool:
    return os.path.isdir(DATA)


def connection():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(_plain(v) for v in r) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=repr)


def same_rows(df, con, sql):
    columns, got = rows_of(df)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    assert got == want
