"""Holds queries against their SQL in DuckDB, by rows and types' families."""

from __future__ import annotations

import datetime
import decimal
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def _value(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([_value(x) for x in v])
    return repr(v)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_value(v) for v in r) for r in df.select(*names).collect())


def rows_of_duck(con, sql):
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return [rel.columns[i] for i in order], sorted(tuple(_value(r[i]) for i in order) for r in rel.fetchall())


def kinds(df, con, sql):
    """Columns whose types differ between the two."""
    alike = {"bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"}, "timestamp_ntz": {"TIMESTAMP"}}
    rel = con.sql(sql)
    theirs = dict(zip(rel.columns, map(str, rel.types)))
    return {n: (k, theirs.get(n)) for n, k in df.dtypes if k in alike and theirs.get(n) not in alike[k]}
