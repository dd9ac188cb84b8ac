"""Compare a query's rows with its SQL's, as multisets."""

import math
from collections import Counter
from datetime import date, datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, (str, bytes, date, datetime)):
        return x
    if isinstance(x, (int, float)):
        return None if isinstance(x, float) and math.isnan(x) else round(float(x), 5) + 0.0
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else str(x)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in found)


def differences(spark, con, query, sql, sf_dir):
    """(only in Spark, only in SQL, number of rows)."""
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns), (sorted(columns), sorted(df.columns))
    want = rows(columns, cursor.fetchall())
    return list((got - want).items())[:3], list((want - got).items())[:3], sum(got.values())
