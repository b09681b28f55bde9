"""Run registered queries next to their SQL and compare: python tests/check.py [name ...]"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set threads to 8")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def spark_rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in frame.collect()), key=repr)


def sql_rows(con, sql: str):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
    return sorted(names), rows


def compare(spark, con, sf_dir: str, name: str, query, sql: str | None) -> str:
    start = time.time()
    names, rows = spark_rows(query(spark, sf_dir))
    took = time.time() - start
    if sql is None:
        return f"rows-only {name}: {len(rows)} rows, {took:.2f}s"
    want_names, want = sql_rows(con, sql)
    if names != want_names:
        return f"FAIL {name}: columns {names} != {want_names}"
    if rows != want:
        got, exp = set(rows), set(want)
        return (
            f"FAIL {name}: {len(rows)} rows, expected {len(want)}\n  only here: {sorted(got - exp, key=repr)[:3]}"
            f"\n  only in SQL: {sorted(exp - got, key=repr)[:3]}"
        )
    return f"ok {name}: {len(rows)} rows, {took:.2f}s"


def main() -> int:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:] or list(queries)
    failed = 0
    for name in wanted:
        try:
            line = compare(spark, con, sf_dir, name, queries[name], oracle.get(name))
        except Exception as exc:
            line = f"FAIL {name}: {type(exc).__name__}: {str(exc)[:1500]}"
        failed += line.startswith("FAIL")
        print(line, flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} passed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
