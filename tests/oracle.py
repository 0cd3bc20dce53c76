"""Runs a registered query beside its SQL in DuckDB and compares the rows."""

import math
from pathlib import Path

import duckdb


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, list):
        return tuple(_cell(v) for v in x)
    return str(x) if hasattr(x, "isoformat") else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_cell(r[i]) for i in order) for r in data), key=repr)


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    return rows([c[0] for c in cur.description], cur.fetchall())


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def differ(df, sql, sf_dir):
    """None when both give the same rows, else what differs."""
    (ca, a), (cb, b) = spark_rows(df), sql_rows(sql, sf_dir)
    if ca != cb:
        return f"columns {ca} and {cb}"
    if a == b:
        return None
    sa, sb = set(a), set(b)
    return f"{len(a)} and {len(b)} rows; only here {list(sa - sb)[:3]}, only in SQL {list(sb - sa)[:3]}"
