"""Runs registered queries against their SQL: python tests/compare.py [sf] [query ...]"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def oracle(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con.execute(sql).fetch_df() if hasattr(con.execute("SELECT 1"), "fetch_df") else con.sql(sql).df()


def rows(df: pd.DataFrame) -> list:
    """Sorted rows with columns by name; types must agree up to their width."""
    df = df[sorted(df.columns)]
    out = [tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in df.itertuples(index=False)]
    return sorted(out, key=repr)


def check(spark, sf_dir: str, name: str) -> tuple[bool, int, float, str]:
    began = time.time()
    mine = entry.queries()[name](spark, sf_dir).toPandas()
    took = time.time() - began
    theirs = oracle(sf_dir, entry.oracle_sql()[name])
    if sorted(mine.columns) != sorted(theirs.columns):
        return False, len(mine), took, f"columns {sorted(mine.columns)} and {sorted(theirs.columns)}"
    a, b = rows(mine), rows(theirs)
    note = "" if a == b else f"{len(a)} and {len(b)} rows, {next(((x, y) for x, y in zip(a, b) if x != y), None)}"
    return a == b, len(mine), took, note


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    for q in sys.argv[2:] or entry.oracle_sql():
        try:
            ok, n, took, note = check(session, sf, q)
            print(f"{'ok  ' if ok else 'FAIL'} {q:28} {n:8} rows {took:6.2f} s {note[:600]}", flush=True)
        except Exception as e:
            print(f"FAIL {q:28} {type(e).__name__}: {str(e)[:900]}", flush=True)
