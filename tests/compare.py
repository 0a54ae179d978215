"""Runs registered queries beside their SQL on the same Parquet tables and compares values."""

from __future__ import annotations

import math
import os
import signal
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


def canonical(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return len(got) > 0, f"{len(got)} rows, no SQL", took
    t = time.time()
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    oracle = time.time() - t
    kinds = {d[0]: str(d[1]) for d in res.description}
    if sorted(names) != sorted(df.columns):
        return False, f"columns {df.columns} against {names}", took
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        odd = [f"{c}:{k}/{kinds[c]}" for c, k in df.dtypes if not _same_kind(k, kinds[c])]
        return True, f"{len(a)} rows, sql {oracle:.1f}s" + (f" TYPES {odd}" if odd else ""), took
    left, right = set(a), set(b)
    only_a = [r for r in a if r not in right][:3]
    only_b = [r for r in b if r not in left][:3]
    return False, f"{len(a)} against {len(b)} rows\n   spark {only_a}\n   sql   {only_b}", took


def _same_kind(spark: str, duck: str) -> bool:
    table = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    return table.get(spark, duck).upper() == duck.upper()


def main():
    from urbanloom.catalog.registry import oracle_sql, queries
    from urbanloom.scale import session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = session("compare"), connect(sf)
    qs, sqls = queries(), oracle_sql()
    only = sys.argv[1:]
    bad = 0
    limit = int(os.environ.get("QUERY_SECONDS", "120"))

    def late(*_):
        raise TimeoutError(f"over {limit} s")

    signal.signal(signal.SIGALRM, late)
    for n, fn in qs.items():
        if only and not any(o == n or (o.endswith("*") and n.startswith(o[:-1])) for o in only):
            continue
        signal.alarm(limit)
        try:
            ok, msg, took = compare(spark, con, n, fn, sqls.get(n), sf)
        except Exception as e:
            ok, msg, took = False, f"{type(e).__name__}: {str(e)[:600]}", 0.0
        signal.alarm(0)
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n} {took:.1f}s {msg}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
