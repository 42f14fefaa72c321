"""Run registered queries on Spark and their SQL on DuckDB, and compare every row.

    python tools/check.py [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fanout.plans.registry import oracle_sql, queries  # noqa: E402
from fanout.session import local_session  # noqa: E402

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(folder: str):
    con = duckdb.connect()
    for table in sorted(Path(folder).glob("*.parquet")):
        files = f"{table}/*.parquet" if table.is_dir() else table
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{files}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(timespec="microseconds")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, con, folder, name, query, sql) -> str | None:
    """None if the two agree, else what differs."""
    df = query(spark, folder)
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    if sql is None:
        return None if got else "no rows"
    result = con.execute(sql)
    want_names = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    want = result.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    odd = {
        f.name: (f.dataType.simpleString(), types[f.name])
        for f in df.schema.fields
        if KINDS.get(f.dataType.simpleString(), types[f.name]) != types[f.name]
    }
    a, b = rows_of(got_names, got), rows_of(want_names, want)
    if a != b:
        return (
            f"{len(got)} rows against {len(want)}\n  columns {sorted(got_names)}\n"
            f"  only Spark {list((a - b).items())[:3]}\n  only SQL   {list((b - a).items())[:3]}"
        )
    if odd:
        return f"types differ: {odd}"
    return None


def main() -> int:
    p = argparse.ArgumentParser()
    p.add_argument("names", nargs="*")
    p.add_argument("--sf", default="0.01")
    p.add_argument("--data", default="/root/testdata")
    args = p.parse_args()
    folder = f"{args.data}/sf{args.sf}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls = oracle_sql()
    failed = []
    for name, query in queries().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        t = time.time()
        try:
            problem = check(spark, con, folder, name, query, sqls.get(name))
        except Exception as e:  # report and go on to the next query
            problem = f"{type(e).__name__}: {str(e)[:1200]}"
        mark = "FAIL" if problem else ("ok  " if name in sqls else "rows")
        print(f"{mark} {name} {time.time() - t:.1f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
