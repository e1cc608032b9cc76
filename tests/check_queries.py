"""Run registered queries next to their SQL: ``python -m tests.check_queries [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from read_parquet('{sf}/{table}.parquet')")
    return db


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows), key=repr
    )


def compare(spark, db, sf, name):
    """None if the query and its SQL agree, else what differs."""
    df = entry.queries()[name](spark, sf)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"no SQL, {len(got[1])} rows" if got[1] else "no rows"
    result = db.execute(sql)
    expected = normal([d[0] for d in result.description], result.fetchall())
    if got[0] != expected[0]:
        return f"columns {got[0]} against {expected[0]}"
    if got[1] == expected[1]:
        return None
    first = next((p for p in zip(got[1], expected[1], strict=False) if p[0] != p[1]), None)
    return f"{len(got[1])} rows against {len(expected[1])}, first difference {first}"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf)
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, db, sf, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if problem is None else 'DIFF'} {time.time() - start:6.1f}s {name}"
              f" {problem or ''}", flush=True)


if __name__ == "__main__":
    main()
