"""Run a registered query in Spark and its oracle SQL in DuckDB; compare.

Usable from pytest and from the command line:
    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (2, v)
    if isinstance(v, (int,)) and not isinstance(v, bool):
        return (2, float(v))
    return (3, str(v))


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "float": "FLOAT", "boolean": "BOOLEAN", "smallint": "SMALLINT",
                 "tinyint": "TINYINT", "date": "DATE"}


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sorted(sdf.columns)
    s_rows = [tuple(r[c] for c in s_cols) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    s_types = dict(sdf.dtypes)
    d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    type_diff = {c: (s_types[c], d_types.get(c)) for c in s_types
                 if SPARK_TO_DUCK.get(s_types[c], s_types[c]) != d_types.get(c)}
    d_cols_orig = rel.columns
    d_rows_raw = rel.fetchall()
    d_cols = sorted(d_cols_orig)
    idx = [d_cols_orig.index(c) for c in d_cols]
    d_rows = [tuple(r[i] for i in idx) for r in d_rows_raw]
    # the same frames through pandas: NULLs in an integer column would make
    # Spark's side float64 and DuckDB's side a nullable integer
    s_pd = dict(sdf.toPandas().dtypes.astype(str))
    d_pd = dict(con.sql(sql).df().dtypes.astype(str))
    pandas_diff = {c: (s_pd[c], d_pd.get(c)) for c in s_pd if s_pd[c] != d_pd.get(c)}
    res = {"name": name, "spark_s": round(t1 - t0, 3), "rows": (len(s_rows), len(d_rows)),
           "cols_match": s_cols == d_cols, "type_diff": type_diff, "pandas_diff": pandas_diff}
    if s_cols != d_cols:
        res["cols"] = (s_cols, d_cols)
        res["ok"] = False
        return res
    a = sorted(tuple(_norm(v) for v in r) for r in s_rows)
    b = sorted(tuple(_norm(v) for v in r) for r in d_rows)
    res["exact"] = a == b
    maxdiff = 0.0
    if len(a) == len(b) and not res["exact"]:
        for ra, rb in zip(a, b):
            for va, vb in zip(ra, rb):
                if va[0] == 2 and vb[0] == 2:
                    maxdiff = max(maxdiff, abs(va[1] - vb[1]))
                elif va != vb:
                    maxdiff = float("inf")
        res["first_diff"] = next(((ra, rb) for ra, rb in zip(a, b) if ra != rb), None)
    res["maxdiff"] = maxdiff
    res["ok"] = res["exact"]
    return res


def main(argv):
    from jobscope.session import local_session
    import __spark_entry__ as E
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(E.queries())
    spark = local_session(8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for n in names:
        if n not in sqls:
            df = qs[n](spark, sf_dir)
            print(f"{n}: rows-only {df.count()} rows, cols {df.columns}")
            continue
        r = compare(spark, con, n, qs[n], sqls[n], sf_dir)
        bad += not r["ok"]
        print(r)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main(sys.argv)
