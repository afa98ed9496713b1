"""Run registered queries beside their reference SQL and compare the rows.

    python -m tests.compare [sf_dir] [name ...]
"""

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

SF = "/root/testdata/sf0.01"


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else f"{v:.6f}" if math.isfinite(v) else str(v)
    if hasattr(v, "as_tuple"):
        return plain(float(v))
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ")[:26] if hasattr(v, "hour") else v.isoformat()
    return str(v)


def bag(columns, rows) -> tuple[list, Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> str | None:
    got_cols, got = bag(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_cols, want = bag([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        return f"rows {sum(got.values())} != {sum(want.values())}; extra {list((got - want).items())[:2]}; missing {list((want - got).items())[:2]}"
    return None if got else "no rows"


def main(argv):
    from logmeld.session import build_session

    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else SF
    spark = build_session(master="local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "10g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    bad = 0
    for name in names:
        started = time.time()
        try:
            df = queries[name](spark, sf_dir)
            problem = differences(df, con, oracles[name]) if name in oracles else (
                f"rows only: {df.count()}")
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:28s} {time.time() - started:6.1f}s {'ok' if problem is None else problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main(sys.argv[1:])
