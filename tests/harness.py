"""Compare queries with their SQL on the same tables."""

import datetime
import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def differences(spark, con, name, sf_dir, queries, sql):
    df = queries[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    cur = con.execute(sql[name])
    have = [c[0] for c in cur.description]
    if sorted(have) != cols:
        return f"columns {cols} and {sorted(have)}"
    want = sorted(repr(tuple(plain(r[have.index(c)]) for c in cols)) for r in cur.fetchall())
    if not want:
        return "no rows"
    if got != want:
        a, b = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        return f"{len(got)} and {len(want)} rows; only Spark: {a}; only SQL: {b}"
    return ""
