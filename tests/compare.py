"""Comparison of a Spark result with a DuckDB result: columns by name, rows in any order."""

import datetime as dt
import decimal
import math


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (bytearray, bytes)):
        return bytes(x).hex()
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x


def order(row):
    return [(v is None, type(v).__name__, str(v)) for v in row]


def rows_of(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in at] for r in rows), key=order)


def same(frame, duck, sql):
    """Assert that both hold the same columns and rows; the number of rows."""
    rel = duck.sql(sql)
    names = list(rel.columns)
    assert sorted(frame.columns) == sorted(names)
    ours, theirs = rows_of(frame.columns, [tuple(r) for r in frame.collect()]), rows_of(names, rel.fetchall())
    assert len(ours) == len(theirs), f"{len(ours)} rows; the SQL gives {len(theirs)}"
    for a, b in zip(ours, theirs):
        assert a == b, f"\nspark  {a}\nduckdb {b}"
    return len(ours)
