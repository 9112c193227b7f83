"""Run a registered query and its SQL on the same files and compare the rows as multisets."""

import math
import os
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb


def connect(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(data):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{data}/{f}'")
    return con


def _cell(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float, Decimal)):
        return None if isinstance(x, float) and math.isnan(x) else float(f"{float(x):.9g}")
    if isinstance(x, datetime):
        return x.date().isoformat() if (x.hour, x.minute, x.second, x.microsecond) == (0, 0, 0, 0) else x.isoformat()
    return x.isoformat() if isinstance(x, date) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def check(spark, con, data, query, sql):
    df = query(spark, data)
    got = rows_of(df.columns, df.collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows_of(names, res.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
