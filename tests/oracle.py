"""Compare registered queries with their SQL counterparts.

    python tests/oracle.py [--sf DIR] [NAME-PREFIX ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(v):
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, decimal.Decimal):
        return ("DECIMAL", str(v))
    if isinstance(v, float):
        if math.isnan(v):
            return ("f", "nan")
        return ("f", repr(v))
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return ("t", str(v))
    if isinstance(v, list):
        return ("l", tuple(_norm(x) for x in v))
    return ("s", v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


TYPE = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}


def compare(spark, con, name, fn, sql, sf_dir):
    """None when equal, else a description of the first difference."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(x) for x in df.collect()])
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rows_of(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    duck_types = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    spark_types = {f.name: TYPE.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    if duck_types != spark_types:
        return f"types {[(c, spark_types[c], duck_types[c]) for c in names if spark_types[c] != duck_types[c]]}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)}/{len(got)} rows differ, first {sorted(names)}:\n   {bad[0][0]}\n   {bad[0][1]}"
    if not got:
        return "no rows"
    return None


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from steadfold.session import local_session

    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf_dir, args = args[1], args[2:]
    spark = local_session(8)
    con = duck(sf_dir)
    sqls = e.oracle_sql()
    failed = 0
    for name, fn in e.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, name, fn, sqls[name], sf_dir)
            else:
                n = len(fn(spark, sf_dir).collect())
                problem = None if n else "no rows"
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc).strip().splitlines()[0][:400]}"
        failed += problem is not None
        kind = "sql " if name in sqls else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {time.time() - start:6.1f}s {name} {problem or ''}", flush=True)
    print(f"{failed} failed")
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
