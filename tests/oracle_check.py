"""Compare registered queries with DuckDB on the same Parquet tables.

``python tests/oracle_check.py [sf] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import __spark_entry__ as entry  # noqa: E402
from ticketweave.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def rows(frame) -> tuple[list[str], list[tuple]]:
    frame = frame[sorted(frame.columns)]

    def plain(value):
        if pd.isna(value):
            return None
        if isinstance(value, float) and value == int(value):
            return str(int(value))
        return str(value)

    values = [tuple(plain(v) for v in row) for row in frame.astype(object).itertuples(index=False, name=None)]
    return list(frame.columns), sorted(values, key=repr)


def compare(spark, connection, folder: str, name: str) -> str:
    """'' if the query agrees with its SQL, otherwise what differs."""
    got_columns, got = rows(entry.queries()[name](spark, folder).toPandas())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "" if got else "no rows"
    want_columns, want = rows(connection.sql(sql).df())
    if got_columns != want_columns:
        return f"columns {got_columns} but expected {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows but expected {len(want)}"
    differ = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(differ)} rows differ, first {str(differ[0])[:600]}" if differ else ""


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(folder)
    for name in sys.argv[2:] or entry.queries():
        start = time.time()
        try:
            result = compare(spark, connection, folder, name)
        except Exception as error:  # report and go on with the next query
            result = f"{type(error).__name__}: {str(error)[:700]}"
        kind = "sql" if name in entry.oracle_sql() else "rows"
        print(f"{name:25s} {kind:4s} {time.time() - start:6.1f}s {'ok' if not result else result}", flush=True)
