"""Run a query on both engines and compare the rows, order ignored."""

import datetime
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def kind(v):
    return {bool: "bool", int: "int", float: "float", str: "str"}.get(type(v), type(v).__name__)


def spark_rows(df):
    names = sorted(df.columns)
    return names, [tuple(plain(r[c]) for c in names) for r in df.collect()]


def duck_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    names = sorted(cols)
    idx = [cols.index(c) for c in names]
    return names, [tuple(plain(r[i]) for i in idx) for r in cur.fetchall()]


def key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def difference(left, right):
    """None if equal, else a short description."""
    (ln, lr), (rn, rr) = left, right
    if ln != rn:
        return f"columns {ln} != {rn}"
    if len(lr) != len(rr):
        return f"rows {len(lr)} != {len(rr)}"
    for a, b in zip(sorted(lr, key=key), sorted(rr, key=key)):
        if a != b or [kind(x) for x in a] != [kind(x) for x in b]:
            return f"{a} != {b}"
    return None
