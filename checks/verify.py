"""Compare registered queries with their SQL: row count, columns and sorted values.

usage: python -m checks.verify SF_DIR [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from ampliq.session import build_session

from .registry import QUERIES, SQL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET enable_progress_bar=false")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    t = time.time()
    got = canonical(QUERIES[name](spark, sf_dir).toPandas())
    t_spark = time.time() - t
    if name not in SQL:
        return True, f"{len(got)} rows, no SQL, {t_spark:.1f}s"
    t = time.time()
    want = canonical(con.sql(SQL[name]).df())
    t_sql = time.time() - t
    note = f"{len(got)} rows, spark {t_spark:.1f}s, sql {t_sql:.1f}s"
    if list(got.columns) != list(want.columns):
        return False, f"columns {list(got.columns)} / {list(want.columns)}"
    if len(got) != len(want):
        return False, f"rows {len(got)} / {len(want)}"
    for c in got.columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        if not same.all():
            i = same[~same].index[0]
            return False, f"{c}: {(~same).sum()} differ, first {got[c][i]!r} / {want[c][i]!r}"
    kinds = [f"{c} {got[c].dtype}/{want[c].dtype}" for c in got.columns if got[c].dtype.kind != want[c].dtype.kind]
    return True, note + (f" types: {kinds}" if kinds else "")


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
