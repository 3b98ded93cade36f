"""Compare registered queries with their SQL twins in DuckDB on one data folder.

    python check.py [--dir DIR] [name-prefix ...]
"""

import argparse
import hashlib
import os
import time

import duckdb
from pyspark.sql import SparkSession

from uttermark.plans import ORACLES, QUERIES
from uttermark.session import clear_scratch

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def make_session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("uttermark-check")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def norm(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--dir", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = make_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(args.dir, t)}.parquet'")
    bad = []
    for name, fn in QUERIES.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, args.dir)
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # report and go on with the next query
            bad.append(name)
            print(f"FAIL {name}: {str(e)[:700]}")
            continue
        t1 = time.time()
        if name not in ORACLES:
            print(f"rows {name}: {len(rows)} rows {t1 - t0:.1f}s  {rows[:1]}"[:300])
            continue
        try:
            cur = con.execute(ORACLES[name])
            cols = [d[0] for d in cur.description]
            want = cur.fetchall()
        except Exception as e:
            bad.append(name)
            print(f"SQLERR {name}: {str(e)[:500]}")
            continue
        a, la = digest(df.columns, rows)
        b, lb = digest(cols, want)
        ok = a == b and sorted(cols) == sorted(df.columns)
        print(f"{'ok  ' if ok else 'DIFF'} {name}: {len(rows)} rows {t1 - t0:.1f}s / sql {time.time() - t1:.1f}s")
        if not ok:
            bad.append(name)
            print("   cols", sorted(df.columns), sorted(cols))
            sa, sb = set(la), set(lb)
            print("   spark only", sorted(sa - sb)[:3])
            print("   sql only  ", sorted(sb - sa)[:3])
    clear_scratch(spark)
    print("bad:", bad)


if __name__ == "__main__":
    main()
