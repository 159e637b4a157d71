"""Run the registered queries beside their SQL and compare the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from buildlens.session import local_session

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, folder):
    """None when equal, else what differs."""
    got = fn(spark, folder)
    left = rows_of(got.columns, [tuple(r) for r in got.collect()])
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    right = rows_of(columns, want.fetchall())
    if sorted(got.columns) != sorted(columns):
        return f"columns {sorted(got.columns)} != {sorted(columns)}"
    if left == right:
        return None
    extra = [r for r in left if r not in set(right)][:2]
    missing = [r for r in right if r not in set(left)][:2]
    return f"{len(left)} rows against {len(right)}; only here {extra}; only there {missing}"


def main(folder: str, names: list[str]) -> None:
    from __spark_entry__ import oracle_sql, queries

    spark = local_session(8)
    con = duck(folder)
    oracles = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, name, fn, oracles[name], folder)
            else:
                problem = None if fn(spark, folder).collect() is not None else "no result"
        except Exception as err:  # report and go on
            problem = f"{type(err).__name__}: {str(err)[:600]}"
        bad += problem is not None
        print(f"{time.time() - start:6.1f}s {name}: {problem or 'ok'}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
