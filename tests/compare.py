"""Run registered queries beside their SQL: ``python tests/compare.py [sf_dir] [name part ...]``."""

import sys
import time
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def tables(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), kind="stable").reset_index(drop=True)


def whole(column):
    """Whole numbers with nulls come as one type or another: as floats with NaN here."""
    return column.astype("float64") if str(column.dtype) == "Int64" else column


def difference(got, want):
    """None if both hold the same rows, else a short reason."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    got, want = canonical(got), canonical(want)
    for name in got.columns:
        a, b = whole(got[name]), whole(want[name])
        if str(a.dtype) != str(b.dtype):
            return f"type of {name}: {a.dtype} / {b.dtype}"
        same = (a.to_numpy() == b.to_numpy()) | (a.isna() & b.isna()).to_numpy()
        if not np.all(same):
            i = int(np.argmin(same))
            return f"{name}: {int((~same).sum())} differ, first {a[i]} / {b[i]}"
    return None


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql = tables(sf_dir), entry.oracle_sql()
    for name, run in entry.queries().items():
        if parts and not any(part in name for part in parts):
            continue
        began = time.time()
        try:
            got = run(spark, sf_dir).toPandas()
        except Exception as error:
            print(f"FAIL {name}: {str(error)[:400]}", flush=True)
            continue
        spent = time.time() - began
        if name not in sql:
            print(f"rows {name}: {got.shape} {spent:.1f}s", flush=True)
            continue
        reason = difference(got, connection.execute(sql[name]).df())
        print(f"{'ok  ' if reason is None else 'DIFF'} {name}: {got.shape} {spent:.1f}s {reason or ''}", flush=True)


if __name__ == "__main__":
    main()
