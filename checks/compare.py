"""Run registered queries next to their SQL and report differences.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd

from checks.registry import oracle_sql, queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def open_tables(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (float, np.floating)):
        return float(value)
    if isinstance(value, (int, np.integer)):
        return float(value)
    return str(value)


def _cells(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(_cell(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def differences(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} / {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} / {len(sql_rows)}"
    a, b = _cells(spark_rows), _cells(sql_rows)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        x, y = wrong[0]
        names = sorted(spark_rows.columns)
        cells = [f"{n}: {p!r} / {q!r}" for n, p, q in zip(names, x, y) if p != q]
        return f"{len(wrong)} of {len(a)} rows differ, first in {'; '.join(cells)[:400]}"
    return None


def main() -> int:
    from tidewatch.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = local_session(cores=8, partitions=8)
    con = open_tables(sf)
    sql = oracle_sql()
    failed = 0
    for name, query in queries().items():
        if args and not any(name == a or name.startswith(a + "_") for a in args):
            continue
        started = time.time()
        try:
            got = query(spark, sf).toPandas()
            took = time.time() - started
            if name in sql:
                problem = differences(got, con.execute(sql[name]).df())
                state = "same" if problem is None else f"DIFFERENT: {problem}"
            else:
                problem, state = None, "no SQL"
        except Exception as error:  # report and go on with the other queries
            took, problem, state = time.time() - started, error, f"ERROR: {str(error)[:600]}"
            got = ()
        failed += problem is not None
        print(f"{name:34s} {len(got):7d} rows {took:7.2f} s  {state}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
