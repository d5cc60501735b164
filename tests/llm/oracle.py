"""Run a query and its SQL on the same tables and compare all rows."""

import glob
import os

import duckdb


def frames(spark, name, sf_dir):
    from kindred.llm import queries as Q

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = Q.queries()[name](spark, sf_dir)
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    cur = con.execute(Q.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = [tuple(r[cols.index(c)] for c in sorted(cols)) for r in cur.fetchall()]
    return sorted(got, key=repr), sorted(want, key=repr)


def assert_equal(spark, name, sf_dir):
    got, want = frames(spark, name, sf_dir)
    assert len(got) == len(want)
    assert got == want
