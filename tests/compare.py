"""Run registered queries on Spark and DuckDB and compare them cell by cell."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

from isotherm.plans import catalogue
from isotherm.plans.registry import REGISTRY, run, statement

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.11g}") + 0.0
    if isinstance(value, int):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def differences(name: str, spark, folder: str, con) -> list[str]:
    frame = run(name, spark, folder)
    got_cols, got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    sql = statement(name)
    if sql is None:
        return [] if got else ["no rows"]
    rel = con.sql(sql)
    want_cols, want = rows_of(list(rel.columns), rel.fetchall())
    if got_cols != want_cols:
        return [f"columns {got_cols} != {want_cols}"]
    problems = []
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        problems.append(f"{len(bad)} rows differ, e.g.\n   spark {bad[0][0]}\n   duck  {bad[0][1]}")
    if not got:
        problems.append("empty result")
    return problems


def main(argv: list[str]) -> int:
    from isotherm.session import local_session

    folder = "/root/testdata/sf0.01"
    catalogue.load()
    names = [n for n in REGISTRY if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    spark, con = local_session(8), connect(folder)
    failed = 0
    for name in names:
        t0 = time.time()
        try:
            problems = differences(name, spark, folder, con)
        except Exception as error:  # noqa: BLE001 - report every query
            problems = [f"{type(error).__name__}: {str(error)[:900]}"]
        failed += bool(problems)
        kind = "sql" if REGISTRY[name].sql else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {name} [{kind}] {time.time() - t0:.1f}s", *problems, sep="\n  " if problems else " ", flush=True)
    print(f"{len(names) - failed}/{len(names)} match")
    return bool(failed)


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
