"""Run queries and oracles side by side: `python tests/check_oracles.py [sf] [name part ...]`."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry_module  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    out = {}
    for c in frame.columns:
        out[c] = [
            "NULL" if (v is None or (not isinstance(v, (list, dict)) and not hasattr(v, "__len__") and pd.isna(v)))
            else repr(float(v)) if isinstance(v, (int, float, bool)) or hasattr(v, "dtype") and getattr(v, "ndim", 1) == 0
            else str(v) for v in frame[c].tolist()
        ]
    out = pd.DataFrame(out, columns=list(frame.columns))
    return out.sort_values(list(out.columns)).reset_index(drop=True) if len(out.columns) else out


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str:
    """Empty text when both hold the same rows."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} != {len(sql_frame)}"
    a, b = canon(spark_frame), canon(sql_frame)
    bad = (a != b).any(axis=1)
    if bad.any():
        return f"{int(bad.sum())} rows differ in {list(a.columns[(a != b).any()])}\n{a[bad].head(4)}\n{b[bad].head(4)}"
    notes = [f"{c}:{spark_frame[c].dtype}/{sql_frame[c].dtype}" for c in sorted(a.columns)
             if spark_frame[c].dtype != sql_frame[c].dtype and "object" not in (str(spark_frame[c].dtype), str(sql_frame[c].dtype))]
    if notes:
        print("   dtypes", notes[:6])
    return ""


def main() -> int:
    from tidemark.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = get_session(), duck(sf_dir)
    oracles, failed = entry_module.oracle_sql(), []
    for name, fn in entry_module.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in oracles:
                print(f"rows  {name} {len(got)} rows, {took:.1f}s, no oracle", flush=True)
                continue
            problem = compare(got, con.execute(oracles[name]).fetchdf())
        except Exception as exc:  # report and go on with the next query
            took, problem = time.time() - start, f"{type(exc).__name__}: {str(exc)[:500]}"
        print(f"{'FAIL' if problem else 'ok  '}  {name} {took:.1f}s (+{time.time() - start - took:.1f}s sql) {problem}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
