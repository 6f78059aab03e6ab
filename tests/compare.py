"""Rows of a query and of its SQL, as sorted lists that can be compared."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return float(value) if type(value).__name__ == "Decimal" else value


def both(spark, query, sql, sf=SF):
    db = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        db.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = query(spark, sf)
    names = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = db.sql(sql)
    columns = list(found.columns)
    assert sorted(columns) == names
    theirs = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall()), key=repr)
    return mine, theirs
