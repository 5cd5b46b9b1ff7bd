"""Compare registered queries with their DuckDB text, the way the correctness gate does."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.9g}" if value else "0"
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 2**53 and value else str(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return str([_cell(v) for v in value])
    return str(value)


def compare(spark, con, query, sql, sf_dir):
    started = time.time()
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(_cell(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    took = time.time() - started
    if sql is None:
        return "rows-only", len(got), took, ""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted((tuple(_cell(row[i]) for i in order) for row in cur.fetchall()), key=repr)
    if columns != sorted(names):
        return "COLUMNS", len(got), took, f"{columns} vs {sorted(names)}"
    if got == want:
        return "ok", len(got), took, ""
    have, need = set(got), set(want)
    missing = [r for r in want if r not in have][:3]
    extra = [r for r in got if r not in need][:3]
    return "DIFF", len(got), took, f"{len(got)} vs {len(want)} rows; columns {columns}\n   spark only {extra}\n   duck only  {missing}"


def main(argv):
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from parcelflow.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session("oracle-check", 8)
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(a in n for a in argv)]
    bad = 0
    for name in names:
        try:
            status, rows, took, detail = compare(spark, con, queries[name], oracles.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            status, rows, took, detail = "ERROR", 0, 0.0, str(error)[:1200]
        bad += status not in ("ok", "rows-only")
        print(f"{status:9} {took:6.1f}s {rows:8d} {name} {detail}", flush=True)
    print("failures:", bad, "of", len(names))


if __name__ == "__main__":
    main(sys.argv[1:])
