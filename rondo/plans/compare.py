"""Order-insensitive comparison of a Spark result with its SQL check."""

from __future__ import annotations

import math

import pandas as pd

from .adapters import BASE_TABLES


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _kind(s: pd.Series) -> str:
    if s.isna().all():
        return "any"
    k = s.dtype.kind
    if k == "O":
        v = s.dropna().iloc[0]
        return "bool" if isinstance(v, bool) else type(v).__name__
    return {"i": "int", "u": "int", "f": "float", "b": "bool", "M": "ts"}.get(k, k)


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return repr(v if v != int(v) or abs(v) > 1e15 else float(v)) if not math.isinf(v) else repr(v)
    if hasattr(v, "item"):
        return _cell(v.item())
    return str(v)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    if len(got) == 0:
        return "no rows"
    cols = sorted(got.columns)
    for c in cols:
        a, b = _kind(got[c]), _kind(want[c])
        nullable_int = {a, b} == {"int", "float"} and (got[c].isna().any() or want[c].isna().any())
        if a != b and "any" not in (a, b) and not nullable_int:
            return f"type of {c}: {a} vs {b}"
        if nullable_int:  # one library turns whole numbers with gaps into floats
            got, want = got.assign(**{c: got[c].astype("Int64")}), want.assign(**{c: want[c].astype("Int64")})

    def rows(df):
        return sorted("|".join(_cell(v) for v in r) for r in df[cols].itertuples(index=False, name=None))

    x, y = rows(got), rows(want)
    if x != y:
        sx, sy = set(x), set(y)
        return f"{len(sx - sy)} rows differ, cols {cols}: {sorted(sx - sy)[:2]} vs {sorted(sy - sx)[:2]}"
    return None
