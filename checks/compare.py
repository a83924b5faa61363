"""Run the checked queries on Spark and their oracles on DuckDB and compare whole results."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def cell(v):
    if v is None:
        return None
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, cell(x)) for k, x in sorted(v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, check, sf_dir, verbose=True) -> bool:
    start = time.time()
    df = check.run(spark, sf_dir)
    types = dict(df.dtypes)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if check.sql is None:
        print(f"rows  {check.name}: {len(got)} rows, {took:.1f}s", flush=True)
        return bool(got)
    start = time.time()
    res = con.execute(check.sql)
    names = [d[0] for d in res.description]
    kinds = {d[0]: str(d[1]) for d in res.description}
    want = res.fetchall()
    duck = time.time() - start
    a, b = rows_of(df.columns, got), rows_of(names, want)
    ok = sorted(df.columns) == sorted(names) and a == b
    print(f"{'ok   ' if ok else 'DIFF '} {check.name}: spark {len(a)} duck {len(b)} rows, {took:.1f}s / {duck:.1f}s", flush=True)
    odd = {c: (types[c], kinds.get(c)) for c in types if not _same_type(types[c], kinds.get(c, ""))}
    if odd and verbose:
        print("      types", odd)
    if not ok and verbose:
        print("      columns", sorted(set(df.columns) ^ set(names)))
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        cols = sorted(df.columns)
        print("      differing rows", len(bad))
        for x, y in bad[:3]:
            print("      ", [(c, p, q) for c, p, q in zip(cols, x, y) if p != q][:6])
    return ok


_ALIKE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
          "timestamp": "TIMESTAMP", "boolean": "BOOLEAN"}


def _same_type(spark_type, duck_type):
    return _ALIKE.get(spark_type, duck_type) == duck_type


def main(argv):
    import duckdb

    from checks import CHECKS
    from marketloom.session import build_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    picked = argv[2:]
    failed = []
    for name, c in CHECKS.items():
        if picked and not any(name.startswith(p) for p in picked):
            continue
        try:
            if not compare(spark, con, c, sf_dir):
                failed.append(name)
        except Exception as e:  # report every query, then fail
            print(f"ERROR {name}: {str(e)[:900]}", flush=True)
            failed.append(name)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv))
