"""Run named queries and their SQL twins side by side: `python tests/check_twins.py [sf_dir] [name ...]`."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(where: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{where}/{name}.parquet')")
    return con


def canonical(value) -> str:
    """Text that differs for int and float and for 0.0 and -0.0."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return repr(value)


def twin_rows(con, sql: str) -> tuple[list[str], list[tuple[str, ...]]]:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(canonical(row[i]) for i in order) for row in found.fetchall())


def query_rows(df) -> tuple[list[str], list[tuple[str, ...]]]:
    names = sorted(df.columns)
    return names, sorted(tuple(canonical(row[n]) for n in names) for row in df.collect())


def compare(spark, con, where: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    names, rows = query_rows(fn(spark, where))
    took = time.time() - start
    if sql is None:
        return True, f"{name}: {len(rows)} rows, no twin ({took:.1f}s)"
    twin_names, twins = twin_rows(con, sql)
    if names != twin_names:
        return False, f"{name}: columns differ: {set(names) ^ set(twin_names)}"
    if rows != twins:
        ours, theirs = set(rows) - set(twins), set(twins) - set(rows)
        return False, (
            f"{name}: {len(rows)} rows against {len(twins)}; {names}\n"
            f"  only here {sorted(ours)[:2]}\n  only there {sorted(theirs)[:2]} ({len(ours)}/{len(theirs)})"
        )
    return True, f"{name}: {len(rows)} rows equal ({took:.1f}s)"


if __name__ == "__main__":
    import __spark_entry__ as contract

    from daypanel.session import build_session

    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    twins = contract.oracle_sql()
    bad = 0
    for key, fn in contract.queries().items():
        if len(sys.argv) > 2 and key not in sys.argv[2:]:
            continue
        try:
            ok, text = compare(session, connect(where), where, key, fn, twins.get(key))
        except Exception as error:  # the check goes on with the next query
            ok, text = False, f"{key}: {type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", text, flush=True)
    print("failed:", bad)
