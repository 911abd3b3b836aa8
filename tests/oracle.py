"""Runs a query and its DuckDB SQL over the same tables and compares all rows."""

import datetime
import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def compare(spark, query, sql, sf_dir=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    mine = sorted((tuple(cell(r[c]) for c in order) for r in df.collect()), key=str)
    theirs = sorted((tuple(cell(r[names.index(c)]) for c in order) for r in out.fetchall()), key=str)
    assert mine == theirs
