"""Run registered queries next to their SQL on DuckDB and compare whole results.

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import threading
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if hasattr(v, "as_tuple"):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, con, name, query, oracle, folder):
    t0 = time.time()
    df = query(spark, folder)
    got_cols = df.columns
    got = rows_of(got_cols, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    if oracle is None:
        return True, f"rows-only {len(got)} ({took:.1f}s)"
    cur = con.execute(oracle)
    want_cols = [d[0] for d in cur.description]
    want = rows_of(want_cols, cur.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return False, f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    if len(got) != len(want):
        a, b = set(got), set(want)
        return False, f"rows {len(got)} != {len(want)}; only spark {list(a - b)[:2]} only sql {list(b - a)[:2]}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return False, f"{len(bad)} of {len(got)} rows differ; columns {sorted(got_cols)}; first {bad[:2]}"
    return True, f"{len(got)} rows ({took:.1f}s)"


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from assaylake.session import local_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = local_session("oracle-check", "8")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name, query in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
        timer = threading.Timer(float(os.environ.get("QUERY_LIMIT", "60")), spark.sparkContext.cancelJobGroup, [name])
        timer.start()
        try:
            ok, note = compare(spark, con, name, query, oracles.get(name), folder)
        except Exception as exc:  # report and go on with the next query
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        timer.cancel()
        print(("ok   " if ok else "FAIL ") + name + ": " + note, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
