"""Compare registered queries with their SQL on one scale: python tests/check.py [-s sf] [name-prefix ...]"""

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    if v.__class__.__name__ == "Decimal":
        return round(float(v), 9)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    spent = time.time() - t0
    if sql is None:
        return f"rows {len(got)}", spent, 0.0, True
    t0 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    t1 = time.time() - t0
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}", spent, t1, False
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return f"ok {len(a)}", spent, t1, bool(a)
    sa, sb = set(map(repr, a)), set(map(repr, b))
    return (f"DIFF {len(a)} vs {len(b)}; only spark {len(sa - sb)} {sorted(sa - sb)[:2]} only sql {len(sb - sa)} {sorted(sb - sa)[:2]}",
            spent, t1, False)


def main(argv):
    sf = "0.01"
    if argv[:1] == ["-s"]:
        sf, argv = argv[1], argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    import __spark_entry__ as e
    from boxloom.session import build

    spark = build("check")
    con = duck(sf_dir)
    sqls = e.oracle_sql()
    bad = 0
    for name, fn in e.queries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        try:
            text, a, b, ok = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as err:  # noqa: BLE001
            text, a, b, ok = "ERROR " + str(err)[:700], 0, 0, False
            if "-v" in argv:
                traceback.print_exc()
        bad += not ok
        print(f"{'   ' if ok else '***'} {name:44s} spark {a:6.2f}s sql {b:6.2f}s {text}", flush=True)
    print("bad", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
