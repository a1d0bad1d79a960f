"""Compares queries with their SQL: python tests/verify_sql.py [data directory] [name prefix …]."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__  # noqa: E402


def canon(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def value(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "~"
        if isinstance(x, float):
            return str(int(x)) if x == int(x) else f"{x:.6g}"
        if hasattr(x, "__len__") and not isinstance(x, str):
            return str([value(y) for y in x])
        return str(x)

    return sorted(tuple(value(x) for x in row) for row in df.itertuples(index=False, name=None))


def main(data: str, prefixes: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    oracle, bad = __spark_entry__.oracle_sql(), 0
    for name, query in __spark_entry__.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        began = time.time()
        try:
            ours = query(spark, data).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{name:28} ERROR {str(e)[:300]}")
            bad += 1
            continue
        took = time.time() - began
        if name not in oracle:
            print(f"{name:28} rows {len(ours):8} {took:6.1f} s   no SQL")
            continue
        began = time.time()
        theirs = db.execute(oracle[name]).df()
        a, b = canon(ours), canon(theirs)
        same = sorted(ours.columns) == sorted(theirs.columns) and a == b
        bad += not same
        print(f"{name:28} rows {len(ours):8} {took:6.1f} s   {'same' if same else 'DIFFERENT'} (SQL {time.time() - began:.1f} s)")
        if not same:
            print("   ", sorted(ours.columns), sorted(theirs.columns), len(a), len(b))
            mine, other = set(a), set(b)
            print("    only ours", [x for x in a if x not in other][:3], "only SQL", [x for x in b if x not in mine][:3])
    return bad


if __name__ == "__main__":
    args = sys.argv[1:] or ["/root/testdata/sf0.01"]
    sys.exit(bool(main(args[0], args[1:])))
