"""Order-free comparison of a Spark result with a SQL result."""

from __future__ import annotations

import datetime as dt
import decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _kind(t) -> str:
    t = str(t)
    if t.startswith(("int", "uint")):
        return "int"
    return "text" if "string" in t else "float" if t in ("double", "float") else "time" if t.startswith("timestamp") else t


def _rows(table):
    names = sorted(table.column_names)
    columns = [[_plain(v) for v in table.column(n).to_pylist()] for n in names]
    return names, sorted(zip(*columns), key=repr), {n: _kind(table.schema.field(n).type) for n in names}


def differences(df, con, check: str) -> list[str]:
    """Empty when both have the same columns, types and rows."""
    ours = df.toArrow()
    theirs = con.sql(check).to_arrow_table()
    a_names, a_rows, a_types = _rows(ours)
    b_names, b_rows, b_types = _rows(theirs)
    if a_names != b_names:
        return [f"columns {a_names} != {b_names}"]
    out = [f"type of {n}: {a_types[n]} != {b_types[n]}" for n in a_names if a_types[n] != b_types[n] and "null" not in (a_types[n], b_types[n])]
    if len(a_rows) != len(b_rows):
        out.append(f"rows {len(a_rows)} != {len(b_rows)}")
    if not a_rows:
        out.append("no rows")
    for a, b in zip(a_rows, b_rows):
        if a != b:
            bad = [(n, x, y) for n, x, y in zip(a_names, a, b) if x != y]
            out.append("first difference " + "; ".join(f"{n}: {str(x)[:120]!r} != {str(y)[:120]!r}" for n, x, y in bad))
            break
    return out
