"""Runs registered queries beside their SQL; used by the tests and from the command line.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import __spark_entry__ as contract  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True)


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """None when equal as sets of rows, else what differs."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    a, b = _sorted(ours), _sorted(theirs)
    kinds = [(c, a[c].dtype, b[c].dtype) for c in a.columns if str(a[c].dtype) != str(b[c].dtype)]
    if kinds and len(a):
        return f"types {kinds}"
    for c in a.columns:
        bad = a[c].astype(str) != b[c].astype(str)
        if bad.any():
            return f"{int(bad.sum())} values of {c}, first {a[bad].iloc[0].to_dict()} and {b[bad].iloc[0].to_dict()}"
    return None


def main() -> None:
    from mediarec import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf), contract.oracle_sql()
    names = sys.argv[2:] or list(contract.queries())
    failed = []
    for name in names:
        t = time.time()
        try:
            ours = contract.queries()[name](spark, sf).toPandas()
        except Exception as e:
            failed.append(name)
            print(name, "SPARK", str(e)[:600].replace("\n", " "), flush=True)
            continue
        t, t0 = time.time() - t, time.time()
        if name not in sql:
            print(f"{name:28} rows only {len(ours):8} {t:6.2f}s", flush=True)
            continue
        try:
            diff = difference(ours, con.execute(sql[name]).fetchdf())
        except Exception as e:
            diff = "SQL " + str(e)[:600].replace("\n", " ")
        if diff:
            failed.append(name)
        print(f"{name:28} {'ok' if not diff else 'DIFF ' + diff} {len(ours):8} {t:6.2f}s sql {time.time() - t0:.2f}s", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
