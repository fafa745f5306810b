"""Run registered queries in Spark and their SQL in DuckDB, and compare the rows.

    python tests/compare.py [name ...]      environment: SF_DIR, default sf0.01
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from marketprose.queries.inputs import TABLES  # noqa: E402


def database(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple((type(_plain(r[i])).__name__, _plain(r[i])) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def differences(spark, con, name: str, sf_dir: str) -> tuple[int, list[str]]:
    """Number of Spark rows, and what differs."""
    df = entry.queries()[name](spark, sf_dir)
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got), []
    cur = con.execute(sql)
    want_cols, want = _rows([d[0] for d in cur.description], cur.fetchall())
    problems = []
    if got_cols != want_cols:
        problems.append(f"columns {got_cols} / {want_cols}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} / {len(want)}")
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        problems += [f"spark only: {x[:600]}" for x in sorted(a - b)[:2]]
        problems += [f"sql only:   {x[:600]}" for x in sorted(b - a)[:2]]
        problems.append(f"{len(a - b)} / {len(b - a)} rows differ")
    return len(got), problems


def main() -> int:
    from marketprose.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(
        spark__master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = database(sf_dir)
    names = sys.argv[1:] or list(entry.queries())
    bad = 0
    for name in names:
        start = time.time()
        try:
            n, problems = differences(spark, con, name, sf_dir)
        except Exception as e:  # report and go on with the next query
            n, problems = -1, [f"{type(e).__name__}: {str(e)[:1500]}"]
        kind = "" if name in entry.oracle_sql() else " (rows only)"
        print(f"{'FAIL' if problems else 'ok  '} {name}: {n} rows {time.time() - start:.1f}s{kind}", flush=True)
        for p in problems:
            print("     ", p)
        bad += bool(problems)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
