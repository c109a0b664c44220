"""Run registered queries next to their SQL twins and report differences. Usage: python tests/oracle.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
DATA = "/root/testdata"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if hasattr(v, "tolist"):
        return tuple(normal(x) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def close(a, b):
    if isinstance(a, float) and isinstance(b, (float, int)) or isinstance(b, float) and isinstance(a, int):
        return a == b or abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    return a == b


def compare(spark, con, name, fn, sql, sf_dir) -> str:
    got = fn(spark, sf_dir)
    got_rows = rows_of(got.columns, [tuple(r) for r in got.collect()])
    if sql is None:
        return f"rows-only {len(got_rows)}" if got_rows else "EMPTY (rows-only)"
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    want_rows = rows_of(cols, rel.fetchall())
    if sorted(cols) != sorted(got.columns):
        return f"COLUMNS {sorted(got.columns)} != {sorted(cols)}"
    kinds = {c[0]: str(c[1]) for c in rel.description}
    spark_kinds = {f.name: f.dataType.simpleString() for f in got.schema.fields}
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    bad = {c: (k, kinds[c]) for c, k in spark_kinds.items() if k in pairs and pairs[k] != kinds[c]}
    if len(got_rows) != len(want_rows):
        return f"ROWS {len(got_rows)} != {len(want_rows)}"
    if got_rows != want_rows:
        diff = [(g, w) for g, w in zip(got_rows, want_rows) if g != w]
        near = all(len(g) == len(w) and all(close(x, y) for x, y in zip(g, w)) for g, w in diff)
        return f"{'NEAR' if near else 'VALUES'} {len(diff)} of {len(got_rows)} differ, first {diff[0]}"
    if not got_rows:
        return "EMPTY"
    return f"ok {len(got_rows)}" + (f" TYPES {bad}" if bad else "")


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from keyloom.session import local_session
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0][0].isdigit() else "0.01"
    sf_dir = f"{DATA}/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sqls = duck(sf_dir), queries(), oracle_sql()
    failed = 0
    for name, fn in qs.items():
        if args and not any(name.startswith(a.rstrip("*")) if a.endswith("*") else a == name for a in args):
            continue
        t = time.time()
        try:
            result = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            result = f"ERROR {type(e).__name__} {str(e)[:600]}"
        failed += not result.startswith(("ok", "rows-only")) or "TYPES" in result
        print(f"{name:45s} {time.time() - t:6.2f}s {result}", flush=True)
    print("failed", failed, flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
