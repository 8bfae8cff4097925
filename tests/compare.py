"""Run a query and its SQL form and compare rows, names and types."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb

from workload.registry import TABLES


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else ("-0.0" if v == 0 and math.copysign(1, v) < 0 else v)
    if isinstance(v, date) and not isinstance(v, datetime):
        return datetime(v.year, v.month, v.day)
    return v


def _family(t: str) -> str:
    t = str(t).upper()
    for family, words in {
        "long": ("BIGINT",), "int": ("INT",), "double": ("DOUBLE", "FLOAT"), "text": ("VARCHAR", "STRING"),
        "bool": ("BOOL",), "time": ("TIMESTAMP", "DATE"),
    }.items():
        if any(t.startswith(w) for w in words):
            return family
    return t.lower()


def _sorted_rows(rows):
    return sorted((tuple(map(_cell, r)) for r in rows), key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def differences(spark, con, run, sql: str, folder: str) -> str | None:
    """None when both agree, else what differs."""
    df = run(spark, folder)
    result = con.execute(sql)
    described = [(d[0], _family(d[1])) for d in result.description]
    expected_rows = result.fetchall()
    ours = sorted(df.columns)
    theirs = sorted(n for n, _ in described)
    if ours != theirs:
        return f"columns {ours} != {theirs}"
    types = {f.name: _family(f.dataType.simpleString()) for f in df.schema.fields}
    if (mine := [types[n] for n in ours]) != (other := [dict(described)[n] for n in theirs]):
        return f"types {list(zip(ours, mine))} != {other}"
    place = [[n for n, _ in described].index(n) for n in theirs]
    a = _sorted_rows([tuple(r[n] for n in ours) for r in df.collect()])
    b = _sorted_rows([tuple(r[i] for i in place) for r in expected_rows])
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}; first {a[:2]} / {b[:2]}"
    for x, y in zip(a, b):
        if x != y:
            return f"{sum(p != q for p, q in zip(a, b))} of {len(a)} rows differ in {ours}: {x} != {y}"
    return None
