"""Runs registered queries against their SQL in DuckDB and compares the results."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from filingloom.session import TABLES, build_session


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype).startswith("str"):
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or v != v else str(v))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def differences(key, build, sql, spark, con, sf_dir, show=False) -> str | None:
    """None if equal, else a short description."""
    t0 = time.time()
    got = build(spark, sf_dir).toPandas()
    t1 = time.time()
    want = con.execute(sql).df()
    t2 = time.time()
    if show:
        print(f"{key:28s} rows={len(got):7d} spark={t1 - t0:6.2f}s duck={t2 - t1:6.2f}s", flush=True)
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns}
    wrong = {c: k for c, k in kinds.items() if k[0] != k[1] and "datetime" not in k[0] and got[c].notna().all()}
    if wrong:
        return f"types {wrong}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = canonical(got), canonical(want)
    for c in got.columns:
        a, b = got[c], want[c]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = same.idxmin()
            x, y = str(a[i]), str(b[i])
            at = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            at = max(0, at - 30)
            rows = "\n".join(str({k: str(v)[:60] for k, v in d.loc[i].items()}) for d in (got, want))
            return f"{(~same).sum()} differ in {c}: ..{x[at : at + 90]!r} != ..{y[at : at + 90]!r}\n{rows}"
    return None


def main(sf_dir: str, only: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries

    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = duck(sf_dir), oracle_sql(), 0
    for key, build in queries().items():
        if only and not any(key.startswith(o) for o in only):
            continue
        try:
            if key in oracles:
                problem = differences(key, build, oracles[key], spark, con, sf_dir, show=True)
            else:
                t0 = time.time()
                n = len(build(spark, sf_dir).toPandas())
                print(f"{key:28s} rows={n:7d} spark={time.time() - t0:6.2f}s (rows only)", flush=True)
                problem = None
        except Exception as exc:  # noqa: BLE001 - a report of all keys is wanted
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        if problem:
            bad += 1
            print(f"  FAIL {key}: {problem[:2500]}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.path.insert(0, ".")
    raise SystemExit(main(sys.argv[1], sys.argv[2:]))
