"""Running a registered query and its SQL on the same tables, and comparing the two results."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    """One value in a form that both engines share."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value) if value % 1 else int(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.12g}")
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(picked, key=repr)


def kind(type_name: str) -> str:
    """A coarse type, the same for both engines."""
    t = type_name.lower()
    if t.startswith(("array", "struct", "map")) or t.endswith("[]"):
        return "nested"
    if t.startswith(("decimal", "double", "float", "real")):
        return "real"
    if "int" in t:
        return "int"
    if t.startswith(("varchar", "string")):
        return "text"
    return t.split("(")[0]


def compare(df, con, sql: str) -> str:
    """'' when the results agree, otherwise what differs."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    kinds = {d[0]: kind(str(d[1])) for d in found.description}
    want_columns, want = rows_of(names, found.fetchall())
    got_columns, got = rows_of(df.columns, df.collect())
    if want_columns != got_columns:
        return f"columns: got {got_columns}, want {want_columns}"
    got_kinds = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    if got_kinds != kinds:
        odd = {c: (got_kinds[c], kinds[c]) for c in kinds if got_kinds[c] != kinds[c]}
        return f"types (got, want): {odd}"
    if len(want) != len(got):
        return f"rows: got {len(got)}, want {len(want)}; first got {got[:2]}; first want {want[:2]}"
    for g, w in zip(got, want):
        if g != w:
            return f"values {got_columns}: got {g}, want {w}"
    return ""
