"""Rows of a query beside those of its SQL, as the same values whatever the engine."""

import datetime
import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def database(folder):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if (p := Path(folder, f"{t}.parquet")).exists():
            where = f"{p}/*.parquet" if p.is_dir() else str(p)
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{where}')")
    return db


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str | bytes):
        return v
    if isinstance(v, bytearray):
        return bytes(v)
    if isinstance(v, int | float | Decimal):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, tuple) and hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def difference(spark_df, db, sql):
    """None if both give the same names and rows, else what differs first."""
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    mine, theirs = rows_of(spark_df.columns, spark_df.collect()), rows_of(names, found.fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    return next((f"{a} against {b}" for a, b in zip(mine, theirs) if a != b), None)
