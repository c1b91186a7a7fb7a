"""Run every registered query against its DuckDB oracle and report matches.

Usage: ``python tests/oracle_check.py [sf_dir] [name ...]``. The comparison
mirrors the driver: column names sorted, row counts, and an order-insensitive
hash of the values (exact after the 6-digit rounding both sides apply).
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(_norm(x)) for x in v) + "]"
    if isinstance(v, bool):
        return str(v)
    return str(v)


def digest(columns: list[str], rows: list[tuple]) -> tuple[int, str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(str(_norm(r[i])) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return len(lines), h


def compare(spark, name, fn, sql, sf_dir, con):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return {"name": name, "rows": len(s_rows), "oracle": None, "spark_s": round(t1 - t0, 2)}
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    ok_cols = sorted(s_cols) == sorted(d_cols)
    n_s, h_s = digest(s_cols, s_rows)
    n_d, h_d = digest(d_cols, d_rows)
    out = {
        "name": name,
        "rows": n_s,
        "oracle_rows": n_d,
        "cols_ok": ok_cols,
        "hash_ok": h_s == h_d,
        "spark_s": round(t1 - t0, 2),
    }
    if not (ok_cols and h_s == h_d):
        out["spark_cols"] = sorted(s_cols)
        out["oracle_cols"] = sorted(d_cols)
        order_s = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
        order_d = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
        ls = sorted("|".join(str(_norm(r[i])) for i in order_s) for r in s_rows)
        ld = sorted("|".join(str(_norm(r[i])) for i in order_d) for r in d_rows)
        diff_s = [x for x in ls if x not in set(ld)][:2]
        diff_d = [x for x in ld if x not in set(ls)][:2]
        out["spark_only"] = [x[:300] for x in diff_s]
        out["oracle_only"] = [x[:300] for x in diff_d]
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as entry
    from tuneframe.session import local_session

    spark = local_session()
    con = duck(sf_dir)
    qs = entry.queries()
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, name, fn, sqls.get(name), sf_dir, con)
        except Exception as e:  # report and continue
            r = {"name": name, "error": repr(e)[:500]}
        flag = "OK " if r.get("hash_ok") or (r.get("oracle") is None and "error" not in r and "hash_ok" not in r) else "BAD"
        if flag == "BAD":
            bad += 1
        print(flag, r, flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
