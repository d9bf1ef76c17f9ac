"""Runs registered queries next to their SQL: python tests/compare.py [name ...]."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return str(sorted((k, canonical(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return str([canonical(x) for x in v])
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    spent = time.time() - t0
    if sql is None:
        return len(got) > 0, f"{len(got)} rows (no SQL) {spent:.1f}s"
    cur = con.execute(sql)
    exp_cols, exp = [d[0] for d in cur.description], cur.fetchall()
    if sorted(got_cols) != sorted(exp_cols):
        return False, f"columns {sorted(got_cols)} != {sorted(exp_cols)}"
    a, b = rows_of(got_cols, got), rows_of(exp_cols, exp)
    if a != b:
        sa, sb = set(a), set(b)
        return False, f"{len(a)} vs {len(b)} rows {spent:.1f}s; only spark {list(sa - sb)[:2]} only sql {list(sb - sa)[:2]}"
    return True, f"{len(a)} rows {spent:.1f}s"


def main(names):
    import __spark_entry__ as entry
    from ownerscope.session import get_session

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark, con = get_session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if names and name not in names and not any(n.endswith("*") and name.startswith(n[:-1]) for n in names):
            continue
        try:
            ok, note = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        print("OK  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print(len(bad), "failed", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
