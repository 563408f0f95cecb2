"""Run registered queries in Spark and their SQL twins in DuckDB, and compare."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "as_tuple"):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _norm(x)) for k, x in sorted(v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name, fn, sql):
    df = fn(spark, sf_dir)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    ocols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if cols != ocols:
        return f"columns {cols} != {ocols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b]
        types = [(a, b) for a, b in zip(got[0], want[0]) if type(a) is not type(b)]
        return f"{len(diff)} rows differ; columns {cols}; first {diff[:2]}; types {types[:3]}"
    if any(type(a) is not type(b) for a, b in zip(got[0], want[0])) if got else False:
        return f"types {[(c, type(a), type(b)) for c, a, b in zip(cols, got[0], want[0]) if type(a) is not type(b)]}"
    return None if got else "no rows"


def main(argv):
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries

    from coverlens.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    q, o = queries(), oracle_sql()
    spark, con = local_session(), connect(sf)
    bad = 0
    for n in q:
        if names and not any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names):
            continue
        t = time.time()
        try:
            err = compare(spark, con, sf, n, q[n], o.get(n))
        except Exception as e:  # report and go on
            err = f"{type(e).__name__}: {str(e)[:700]}"
        bad += err is not None
        print(f"{'FAIL' if err else 'ok  '} {n} {time.time() - t:.1f}s {'' if n in o else '(rows only)'} {err or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
