"""Run registered queries next to their SQL and report differences: ``python tests/compare.py [sf] [name-part ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "~"
        return f"{v + 0.0:.6f}" if abs(v) < 1e15 else f"{v:.6e}"
    if isinstance(v, int):
        return str(v)
    if hasattr(v, "__float__") and not isinstance(v, str):
        return f"{float(v):.6f}"
    return str(v)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in data)


def compare(spark, con, name, fn, sql, sf_dir) -> tuple[bool, str]:
    t = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spark_s = time.time() - t
    if sql is None:
        return len(got) > 0, f"rows={len(got)} spark={spark_s:.1f}s (no SQL)"
    t = time.time()
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows_of(names, res.fetchall())
    duck_s = time.time() - t
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    if got != want:
        gs, ws = set(got), set(want)
        return False, f"rows {len(got)} vs {len(want)}; only spark {sorted(gs - ws)[:2]}; only sql {sorted(ws - gs)[:2]}"
    return len(got) > 0, f"rows={len(got)} spark={spark_s:.1f}s duckdb={duck_s:.1f}s"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pagescale.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    session = local_session(cores="8")
    con = connection(sf_dir)
    sqls = entry.oracle_sql()
    bad = []
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            ok, note = compare(session, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        print("ok  " if ok else "BAD ", name, note[:1500], flush=True)
        if not ok:
            bad.append(name)
    print("bad:", bad)
