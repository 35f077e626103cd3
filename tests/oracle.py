"""Run a registered query on Spark and its SQL on DuckDB, and compare whole results."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, dict, bytearray)):
        raise TypeError("emit nested values as text")
    return value


def kind(name: str) -> str:
    name = name.upper()
    for found, group in (
        ("VARCHAR", "STRING"),
        ("STRING", "STRING"),
        ("BIGINT", "INT64"),
        ("TIMESTAMP", "TIMESTAMP"),
        ("INT", "INT32"),
        ("DOUBLE", "DOUBLE"),
        ("DATE", "DATE"),
        ("BOOL", "BOOL"),
    ):
        if name.startswith(found):
            return group
    return name


def spark_rows(df):
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(v) for v in row) for row in df.select(*columns).collect())
    return columns, {f.name: kind(f.dataType.simpleString()) for f in df.schema}, rows


def duck_rows(con, sql: str):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: kind(str(d[1])) for d in cursor.description}
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    return sorted(names), types, rows


def difference(df, con, sql: str) -> str:
    """Empty when columns, types and all rows agree."""
    columns, types, got = spark_rows(df)
    names, duck_types, want = duck_rows(con, sql)
    if columns != names:
        return f"columns {columns} != {names}"
    wrong = {c: (types[c], duck_types[c]) for c in columns if types[c] != duck_types[c]}
    if wrong:
        return f"types {wrong}"
    if got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"{sum(got.values())} rows vs {sum(want.values())}; only Spark {extra}; only SQL {missing}"[:1500]
    return "" if got else "no rows"
