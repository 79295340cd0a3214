"""Compares a query with its SQL on the same tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    """Values that compare across both engines; doubles to twelve digits."""
    if isinstance(value, float):
        return 0.0 if value == 0 else float(f"{value:.12g}") if math.isfinite(value) else str(value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return _plain(value.asDict())
    return tuple(map(_plain, value)) if isinstance(value, list | tuple) else value


def differences(frame, con, sql: str) -> str:
    """What differs, or an empty text."""
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    order = sorted(names)
    want = Counter(tuple(_plain(row[names.index(c)]) for c in order) for row in found.fetchall())
    got = Counter(tuple(_plain(row[c]) for c in order) for row in frame.collect())
    return "" if got == want else f"{sum(got.values())} rows against {sum(want.values())}; only here {list(got - want)[:2]}; only there {list(want - got)[:2]}"
