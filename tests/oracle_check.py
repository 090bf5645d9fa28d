"""Compare every named query with its SQL. Usage: python tests/oracle_check.py [folder] [name ...]"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t)
    )


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP"}


def compare(df, con, sql) -> str | None:
    """None when equal, otherwise the first difference."""
    got = df.collect()
    rel = con.sql(sql)
    types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    want = rel.fetchall()
    mine = {n: KINDS.get(t, t) for n, t in df.dtypes}
    if sorted(mine) != sorted(types):
        return f"columns {sorted(mine)} != {sorted(types)}"
    a, b = canonical(df.columns, [tuple(r) for r in got])[1], canonical(rel.columns, want)[1]
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{x} != {y}"
    wrong = {c: (mine[c], types[c]) for c in mine if mine[c] != types[c]}
    return f"types {wrong}" if wrong else None


def main() -> int:
    from pyspark.sql import SparkSession
    import __spark_entry__ as entry

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracle:
                found = compare(df, con, oracle[name])
                note = "ok" if found is None else f"DIFF {found}"
            else:
                note = f"rows only: {len(df.collect())}"
        except Exception as e:
            note = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += note.startswith(("DIFF", "ERROR"))
        print(f"{name:32s} {time.time() - start:6.2f}s  {note[:900]}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
