"""A query's rows beside those of its SQL in DuckDB."""

import math
import os

SF = "/root/testdata/sf0.001"


def tables(duckdb):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def _norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    one = lambda v: None if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v
    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


def check(spark, con, query, sql):
    got, want = query(spark, SF), con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert _norm([tuple(r) for r in got.collect()], got.columns) == _norm(want.fetchall(), want.columns)
