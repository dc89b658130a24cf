"""Local correctness check: run a registered query on Spark and its oracle SQL on DuckDB
and compare row count, column names and an order-insensitive hash of the values."""

from __future__ import annotations

import hashlib
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_canon(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_canon(x) for x in v) + "]"
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_canon(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def check(spark, names, sf_dir: str, verbose: bool = True):
    from .catalog import QUERIES

    con = duck(sf_dir)
    results = {}
    for name in names:
        fn, sql = QUERIES[name]
        t0 = time.time()
        sdf = fn(spark, sf_dir)
        s_cols = sdf.columns
        s_rows = [tuple(r) for r in sdf.collect()]
        t1 = time.time()
        if sql is None:
            results[name] = ("rows-only", len(s_rows))
            if verbose:
                print(f"{name}: rows-only {len(s_rows)} rows spark {t1 - t0:.1f}s", flush=True)
            continue
        cur = con.execute(sql)
        d_cols = [c[0] for c in cur.description]
        d_rows = cur.fetchall()
        t2 = time.time()
        hs, ls = digest(s_cols, s_rows)
        hd, ld = digest(d_cols, d_rows)
        ok = sorted(s_cols) == sorted(d_cols) and len(s_rows) == len(d_rows) and hs == hd
        results[name] = ok
        if verbose:
            print(
                f"{name}: {'OK' if ok else 'MISMATCH'} rows spark={len(s_rows)} duck={len(d_rows)} "
                f"cols_equal={sorted(s_cols) == sorted(d_cols)} spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s",
                flush=True,
            )
            if not ok:
                print("  spark cols", s_cols, "duck cols", d_cols)
                sd, dd = set(ls), set(ld)
                for x in sorted(sd - dd)[:3]:
                    print("  only spark:", x[:300])
                for x in sorted(dd - sd)[:3]:
                    print("  only duck: ", x[:300])
    return results


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from scriptorium.plans.catalog import QUERIES
    from scriptorium.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    res = check(spark, names, sf)
    bad = [k for k, v in res.items() if v is False]
    print("FAILED:", bad if bad else "none")
