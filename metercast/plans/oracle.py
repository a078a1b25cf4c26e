"""Compare registered queries with their oracle SQL in DuckDB: row count,
column names and an order-insensitive hash of the values (floats by
``repr``, so equal means bit-identical)."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from ..sources.testdata import TABLES


def _norm(v) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return repr(v)


def digest(cols: list[str], rows: list[tuple]) -> tuple[str, list[str]]:
    """Hash of the rows with columns in name order, rows sorted."""
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


@dataclass
class Outcome:
    name: str
    ok: bool
    rows: int
    detail: str = ""


def duckdb_views(sf_dir: str):
    """A DuckDB connection with the test tables registered as views (UTC)."""
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(df, con, sql: str, name: str = "") -> Outcome:
    """Collect ``df`` (a small result) and the oracle's rows, then compare."""
    srows = [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    dcols, drows = rel.columns, rel.fetchall()
    hs, ls = digest(df.columns, srows)
    hd, ld = digest(dcols, drows)
    if len(srows) == len(drows) and sorted(df.columns) == sorted(dcols) and hs == hd:
        return Outcome(name, True, len(srows))
    only_s = [x for x in ls if x not in set(ld)][:3]
    only_d = [x for x in ld if x not in set(ls)][:3]
    return Outcome(name, False, len(srows),
                   f"rows {len(srows)} vs {len(drows)}; cols {sorted(df.columns)} vs {sorted(dcols)}; "
                   f"spark only {only_s}; duckdb only {only_d}")
