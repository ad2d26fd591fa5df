"""Run a query and its SQL on the same tables, and compare all rows."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({sorted(glob.glob(path + '/*.parquet')) if os.path.isdir(path) else [path]})")
    cur = con.execute(sql)
    return {d[0]: str(d[1]) for d in cur.description}, cur.fetchall()


def same_value(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (a == b and math.copysign(1, a) == math.copysign(1, b)) or (math.isnan(a) and math.isnan(b))
    return a == b and type(a) is type(b)


def assert_same(df, sql, sf_dir):
    kinds, expected = sql_rows(sql, sf_dir)
    names, order = list(kinds), sorted(kinds)
    assert order == sorted(df.columns)
    assert {c: KINDS.get(k, k) for c, k in kinds.items()} == dict(df.dtypes)
    got = [tuple(r[c] for c in order) for r in df.select(*order).collect()]
    want = [tuple(r[names.index(c)] for c in order) for r in expected]
    assert len(got) == len(want)
    key = lambda row: [(v is None, str(type(v)), str(v)) for v in row]
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert all(same_value(x, y) for x, y in zip(g, w, strict=True)), (order, g, w)
