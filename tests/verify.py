"""python tests/verify.py [--sf DIR] [NAME...]: each query against its SQL counterpart in DuckDB."""

from __future__ import annotations

import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from phenorank.session import build_session  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False):
        cells = []
        for v in row:
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
                cells.append("NULL")
            elif isinstance(v, float) or type(v).__name__ in ("float64", "Decimal"):
                cells.append(f"{float(v):.6g}")
            elif isinstance(v, bool):
                cells.append(str(int(v)))
            else:
                cells.append(f"{float(v):.6g}" if hasattr(v, "dtype") and v.dtype.kind in "iub" or isinstance(v, int) else str(v))
        rows.append("|".join(cells))
    return sorted(rows)


def compare(spark, con, name: str, sf_dir: str) -> str:
    began = time.time()
    got = entry.queries()[name](spark, sf_dir).toPandas()
    took = time.time() - began
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"{name}: {len(got)} rows, no SQL, {took:.1f} s"
    want = con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"{name}: COLUMNS {sorted(got.columns)} {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a == b:
        return f"{name}: ok, {len(a)} rows, {took:.1f} s"
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"{name}: DIFFERS {len(a)} {len(b)}; only here {only_a[:4]}; only there {only_b[:4]}"


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark = build_session("verify", "8")
    con = duck(sf)
    for query in args or entry.queries():
        try:
            print(compare(spark, con, query, sf), flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"{query}: ERROR {str(error)[:600]}", flush=True)
