"""Run registered queries beside their DuckDB oracles and report every difference."""

from __future__ import annotations

import datetime
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return value + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql) -> str | None:
    """None if equal, else a short description."""
    cursor = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    have_cols, have = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want_cols != have_cols:
        return f"columns {have_cols} != {want_cols}"
    if have == want:
        kinds = [(c, type(a).__name__, type(b).__name__) for r, q in zip(have, want) for c, a, b in zip(have_cols, r, q)
                 if a is not None and type(a) is not type(b)]
        return f"types {kinds[:3]}" if kinds else (None if have else "EMPTY")
    a, b = set(have), set(want)
    return f"rows {len(have)} vs {len(want)}; only spark {sorted(a - b, key=repr)[:3]}; only sql {sorted(b - a, key=repr)[:3]}"


def main() -> None:
    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    names = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            told = difference(df, con, oracles[name]) if name in oracles else f"(no oracle) {df.count()} rows"
        except Exception as e:  # noqa: BLE001
            told = f"{type(e).__name__}: {str(e)[:700]}"
        state = "ok " if told is None else "-- "
        if told and not told.startswith("(no oracle)"):
            bad.append(name)
        print(f"{state}{name:28s} {time.time() - start:6.1f}s {told or ''}", flush=True)
    print("BAD:", bad)


if __name__ == "__main__":
    main()
