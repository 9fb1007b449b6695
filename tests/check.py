"""Compare registered queries with their SQL twins: python tests/check.py [folder] [name ...]"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    return v


def rows_sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


def compare(spark, con, name, folder, queries, oracle):
    t0 = time.time()
    df = queries[name](spark, folder)
    got = rows_sorted(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    if name not in oracle:
        return True, f"rows={len(got[1])} (no sql) {took:.1f}s"
    t1 = time.time()
    cur = con.execute(oracle[name])
    want_names = [d[0] for d in cur.description]
    want_types = {d[0]: str(d[1]) for d in cur.description}
    want = rows_sorted(want_names, cur.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    bad = {c: (t, want_types[c]) for c, t in df.dtypes if t in kinds and kinds[t] not in want_types[c].upper().replace("STRING", "VARCHAR").replace("NUMBER", "BIGINT DOUBLE").replace("BOOL", "BOOLEAN")}
    note = f" TYPES {bad}" if bad else ""
    if got[1] != want[1]:
        diff = [(a, b) for a, b in zip(got[1], want[1]) if a != b][:2]
        return False, f"rows {len(got[1])} vs {len(want[1])}; cols {got[0]}; first {diff}{note}"
    return not bad, f"rows={len(got[1])} spark {took:.1f}s duck {time.time() - t1:.1f}s{note}"


def main():
    import __spark_entry__ as entry
    from fieldmark import session
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    only = sys.argv[2:]
    spark = session.build("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                                   "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not only or any(n == o or (o.endswith("*") and n.startswith(o[:-1])) for o in only)]
    failed = []
    for n in names:
        try:
            ok, msg = compare(spark, con, n, folder, queries, oracle)
        except Exception as e:  # report and go on with the next query
            causes = [line.strip() for line in str(e).splitlines() if "Caused by" in line]
            ok, msg = False, f"{type(e).__name__}: {' '.join(str(e).split())[:400]} {' '.join(causes)[:600]}"
        print("ok  " if ok else "FAIL", n, msg, flush=True)
        if not ok:
            failed.append(n)
    print(f"{len(names) - len(failed)} of {len(names)} ok; failed: {failed}")


if __name__ == "__main__":
    main()
