"""Run queries next to their SQL in DuckDB and compare the results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else ("f", round(value, 9) + 0.0)
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, int):
        return ("i", value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None if both give the same rows, else a short description."""
    got_columns, want = df.columns, con.execute(sql)
    want_columns = [d[0] for d in want.description]
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    got_rows = _rows(got_columns, [tuple(r) for r in df.collect()])
    want_rows = _rows(want_columns, want.fetchall())
    if len(got_rows) != len(want_rows):
        return f"{len(got_rows)} rows != {len(want_rows)}"
    for g, w in zip(got_rows, want_rows):
        if g != w:
            bad = [(c, str(x)[:150], str(y)[:150]) for c, x, y in zip(sorted(got_columns), g, w) if x != y]
            return f"first difference {bad}"
    return None


if __name__ == "__main__":
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    import __spark_entry__ as entry
    from postlens.session import local_session

    sf = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf)
            sql = entry.oracle_sql().get(name)
            result = difference(df, con, sql) if sql else f"rows only: {len(df.collect())}"
        except Exception as error:  # report and go on
            result = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        bad += bool(result and not result.startswith("rows only"))
        print(f"{name:24s} {time.time() - start:6.2f}s {result or 'ok'}", flush=True)
    print("differences:", bad)
