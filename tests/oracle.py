"""Compare queries with their SQL: ``python tests/oracle.py [--dir DIR] NAME...`` (all without names)."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings relationship attribute resources authority vocabulary books mix_target".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def compare(spark, name: str, q, sql: str, d: str) -> str:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    want = [dict(zip(cols, r)) for r in rel.fetchall()]
    df = q(spark, d)
    got = [r.asDict() for r in df.collect()]
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} / {sorted(cols)}"
    key = lambda r: tuple(str(norm(r[c])) for c in sorted(cols))
    a, b = sorted(map(key, got)), sorted(map(key, want))
    if a != b:
        sa, sb = set(a), set(b)
        return f"rows {len(a)} / {len(b)}; only ours {sorted(sa - sb)[:3]}; only SQL {sorted(sb - sa)[:3]}"
    return ""


def session(n: int = 8):
    from pyspark.sql import SparkSession

    return SparkSession.builder.master(f"local[{n}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main(args: list[str]) -> int:
    import __spark_entry__ as e

    d = "/root/testdata/sf0.01"
    if args[:1] == ["--dir"]:
        d, args = args[1], args[2:]
    spark = session()
    spark.sparkContext.setLogLevel("OFF")
    bad = 0
    for name, q in e.queries().items():
        if args and name not in args:
            continue
        sql = e.oracle_sql().get(name)
        began = time.time()
        try:
            said = compare(spark, name, q, sql, d) if sql else f"-- {q(spark, d).count()} rows, no SQL"
        except Exception as x:
            said = f"ERROR {str(x)[:600]}"
        ok = not said or said.startswith("--")
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {name} {time.time() - began:.1f}s {said}", flush=True)
    return bad


if __name__ == "__main__":
    os._exit(main(sys.argv[1:]))
