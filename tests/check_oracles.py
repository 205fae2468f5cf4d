"""Compare every registered query with its SQL.

    python tests/check_oracles.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime64"):
            df = df.assign(**{c: df[c].astype("datetime64[us]")})
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: "time" if str(t).startswith("datetime64") else str(t) for c, t in df.dtypes.items()}


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    """What differs, or None."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} != {len(sql_df)}"
    a, b = canonical(spark_df), canonical(sql_df)
    if len(a) and kinds(a) != kinds(b):
        return f"types {[(c, kinds(a)[c], kinds(b)[c]) for c in a if kinds(a)[c] != kinds(b)[c]]}"
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = same.idxmin()
            return f"{(~same).sum()} values of {c}, e.g. {a[c][i]!r} != {b[c][i]!r}"
    return None


def main() -> int:
    from tidegauge import build_session

    folder, only = sys.argv[1], set(sys.argv[2:])
    spark = build_session(
        "oracles", "local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(folder), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if only and name not in only:
            continue
        began = time.time()
        try:
            got = run(spark, folder).toPandas()
            took = time.time() - began
            if name not in sql:
                verdict = f"rows-only {len(got)}"
            else:
                problem = difference(got, con.execute(sql[name]).fetchdf())
                verdict = f"ok {len(got)}" if problem is None else f"MISMATCH {problem}"
                bad += problem is not None
        except Exception as error:
            took = time.time() - began
            verdict = f"ERROR {type(error).__name__}: {str(error)[:700]}"
            bad += 1
        print(f"{name:28s} {took:6.2f}s  {verdict}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
