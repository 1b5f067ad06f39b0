"""Rows of a Spark result and of DuckDB's, in a form in which they can be compared."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def both(spark, con, f, sql, sf):
    df = f(spark, sf)
    cur = con.execute(sql)
    kinds = {c[0]: str(c[1]) for c in cur.description}
    return canonical(df.columns, [tuple(r) for r in df.collect()]), canonical([c[0] for c in cur.description], cur.fetchall()), dict(df.dtypes), kinds
