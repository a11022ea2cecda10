"""Run registered queries beside their DuckDB statements: python -m tests.check_oracle [-d sf_dir] [names]"""

from __future__ import annotations

import argparse
import datetime
import math
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """(ok, message)"""
    start = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    spark_time = time.time() - start
    if sql is None:
        return True, f"rows only: {len(got)} rows  spark {spark_time:.1f}s"
    start = time.time()
    con.execute(sql)
    columns = [d[0] for d in con.description]
    want = con.fetchall()
    duck_time = time.time() - start
    note = f"{len(got)} rows  spark {spark_time:.1f}s duck {duck_time:.1f}s"
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a != b:
        extra, missing = list((a - b).items())[:3], list((b - a).items())[:3]
        return False, f"{note}\n   {sorted(columns)}\n   only spark ({sum((a - b).values())}): {extra}\n   only duck ({sum((b - a).values())}): {missing}"
    return True, note


def main():
    import __spark_entry__ as entry
    from folioworks.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("-d", default="/root/testdata/sf0.01")
    parser.add_argument("-m", default=None, help="only queries of modules containing this")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark, con = local_session("8"), duck(args.d)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if (args.names and name not in args.names) or (args.m and args.m not in fn.__module__):
            continue
        try:
            ok, note = compare(spark, con, name, fn, oracles.get(name), args.d)
        except Exception as error:  # keep going, report at the end
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")


if __name__ == "__main__":
    main()
