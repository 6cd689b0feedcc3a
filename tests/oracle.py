"""Run registered queries in Spark and their SQL in DuckDB and compare every value.

    python tests/oracle.py [--sf 0.01] [--rows-per-block N] [--no-broadcast] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _key(row):
    return tuple((v is not None, repr(type(v)) if not isinstance(v, (int, float)) else "n", v if v is not None else 0) for v in row)


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isnan(a) and math.isnan(b)
    return type(a) is type(b) and a == b


def compare(spark_df, con, sql: str) -> str | None:
    """None if equal, else the first difference."""
    names = sorted(spark_df.columns)
    left = sorted((tuple(r[n] for n in names) for r in spark_df.collect()), key=_key)
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != names:
        return f"columns {names} against {sorted(columns)}"
    order = [columns.index(n) for n in names]
    right = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=_key)
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    for a, b in zip(left, right):
        for n, x, y in zip(names, a, b):
            if not same(x, y):
                return f"{n}: {x!r:.400} against {y!r:.400} in {str(a):.300}"
    return None if left else "no rows"


def main() -> int:
    from segmentlab import checks
    from segmentlab.operators import blocks
    from segmentlab.session import build_session

    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("--rows-per-block", type=int)
    args.add_argument("--no-broadcast", action="store_true")
    args.add_argument("names", nargs="*")
    args = args.parse_args()
    if args.rows_per_block:
        blocks.ROWS = args.rows_per_block
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        **({"spark.sql.autoBroadcastJoinThreshold": "-1"} if args.no_broadcast else {})})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = checks.all_queries(), checks.all_sql()
    bad = 0
    for name in args.names or queries:
        started = time.time()
        try:
            df = queries[name](spark, sf_dir)
            problem = compare(df, con, sql[name]) if name in sql else f"rows only: {df.count()}"
        except Exception as e:  # a query that fails is reported like a difference
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(problem) and name in sql
        print(f"{'ok  ' if not problem else 'DIFF' if name in sql else 'rows'} {name} {time.time() - started:.2f}s {problem or ''}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())
