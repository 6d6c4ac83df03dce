"""Compare registered queries with their SQL counterparts: python tests/oracle_check.py [sf_dir] [name...]."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return 0.0 if v == 0 else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime) and v.tzinfo is None and v.time() == datetime.time(0):
        return v.isoformat()
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def sort_key(row):
    return tuple((x is not None, type(x).__name__ if not isinstance(x, (int, float)) else "n", x if x is not None else 0) for x in row)


def compare(spark, con, sf_dir, fn, sql):
    """Return (message or '', n_rows)."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = dict(zip(names, [str(d[1]) for d in cur.description], strict=True))
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}", len(got)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    pair = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "int": "INTEGER"}
    odd = [f"{c}:{kinds[c]}/{types[c]}" for c in cols if pair.get(kinds[c], kinds[c]) != types[c]]
    pos = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in pos) for r in cur.fetchall()]
    msg = f" types {odd}" if odd else ""
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}" + msg, len(got)
    got.sort(key=sort_key)
    want.sort(key=sort_key)
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    if bad:
        return f"{len(bad)} rows differ, cols {cols}, first spark={bad[0][0]} sql={bad[0][1]}" + msg, len(got)
    return msg, len(got)


def main():
    import __spark_entry__ as entry
    from demandlake.session import get_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = get_session(master="local[8]", **{"spark__sql__shuffle__partitions": "8", "spark__driver__memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    names = [q for q in qs if not args or any(q.startswith(a) for a in args)]
    bad = 0
    for q in names:
        t = time.time()
        try:
            if q in sqls:
                msg, n = compare(spark, con, sf_dir, qs[q], sqls[q])
            else:
                msg, n = "", len(qs[q](spark, sf_dir).collect())
                msg = "" if n else "no rows"
        except Exception as e:  # noqa: BLE001
            msg, n = f"ERROR {type(e).__name__}: {str(e)[:600]}", -1
        bad += bool(msg)
        print(f"{'FAIL' if msg else 'ok':4} {q:34} {n:7} rows {time.time() - t:6.1f}s {'sql ' if q in sqls else 'rows'} {msg}", flush=True)
    print(f"{len(names)} queries, {bad} with remarks")


if __name__ == "__main__":
    main()
