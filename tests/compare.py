"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def spark_session():
    from faultline.session import build_session

    return build_session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.sql.streaming.ui.enabled": "false",
            "spark.driver.host": "127.0.0.1",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-"),
        },
    )


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None:
        return ("", "null")
    if isinstance(value, bool):
        return ("b", str(value))
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        if math.isnan(number):
            return ("n", "nan")
        return ("n", f"{number:.9g}")
    if isinstance(value, datetime.datetime):
        return ("t", value.replace(tzinfo=None).isoformat())
    return ("s", str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name, function, sql, sf_dir):
    start = time.perf_counter()
    frame = function(spark, sf_dir)
    got = [tuple(r) for r in frame.collect()]
    seconds = time.perf_counter() - start
    if sql is None:
        return seconds, len(got), None, "rows only" if got else "NO ROWS"
    relation = con.sql(sql)
    want = relation.fetchall()
    if sorted(frame.columns) != sorted(relation.columns):
        return seconds, len(got), len(want), f"COLUMNS {sorted(frame.columns)} / {sorted(relation.columns)}"
    a, b = rows_of(frame.columns, got), rows_of(relation.columns, want)
    if a == b:
        return seconds, len(a), len(b), "ok" if a else "EMPTY"
    left, right = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    detail = "\n    spark " + "\n    spark ".join(str(x)[:600] for x in left[:2])
    detail += "\n    duck  " + "\n    duck  ".join(str(x)[:600] for x in right[:2])
    return seconds, len(a), len(b), f"DIFFERENT ({len(left)} / {len(right)}){detail}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry

    spark, con = spark_session(), duck(args.sf)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, function in queries.items():
        if args.names and not any(part in name for part in args.names):
            continue
        try:
            seconds, n, m, verdict = compare(spark, con, name, function, oracle.get(name), args.sf)
        except Exception as exc:  # noqa: BLE001
            seconds, n, m, verdict = 0, 0, 0, f"FAILED {type(exc).__name__}: {str(exc)[:1500]}"
        bad += verdict not in ("ok", "rows only")
        print(f"{name:32s} {seconds:6.2f}s {n!s:>8} {m!s:>8}  {verdict}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
