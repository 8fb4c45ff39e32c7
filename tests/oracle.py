"""Compare a query's rows with its SQL twin in DuckDB."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _key(row):
    return tuple((v is not None, str(v)) for v in row)


def sql_rows(sql, sf, columns):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    return sorted((tuple(_plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall()), key=_key)


def same(df, sql, sf):
    columns = sorted(df.columns)
    rows = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=_key)
    assert rows == sql_rows(sql, sf, columns)
    return len(rows)
