"""Comparison of a Spark result with DuckDB's: columns by name, rows as multisets or in the oracle's order, kinds of types."""

from __future__ import annotations

import math
import re

KIND = {"tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int", "hugeint": "huge", "double": "float", "float": "float", "string": "text", "varchar": "text", "boolean": "bool", "date": "date", "timestamp_ntz": "ts", "timestamp": "ts"}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


def ordered(sql: str) -> bool:
    """Whether the outermost query has an ORDER BY."""
    return bool(re.search(r"ORDER BY [^()]*$", sql)) and " ORDER BY " in sql.rpartition(")")[2]


def rows(names, data, in_order: bool = False):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]
    return out if in_order else sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def compare(df, connection, sql: str | None) -> str:
    """Empty if equal, else what differs."""
    mine = [tuple(r) for r in df.collect()]
    if sql is None:
        return "" if mine is not None else "no rows"
    found = connection.execute(sql)
    names = [x[0] for x in found.description]
    kinds = {x[0]: KIND.get(str(x[1]).lower(), str(x[1]).lower()) for x in found.description}
    theirs = found.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    own = {n: KIND.get(t, t) for n, t in df.dtypes}
    if own != kinds:
        return f"types {[(n, own[n], kinds[n]) for n in own if own[n] != kinds[n]]}"
    keep = ordered(sql)
    a, b = rows(df.columns, mine, keep), rows(names, theirs, keep)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    return next((f"{x} and {y}" for x, y in zip(a, b, strict=True) if x != y), "")
