"""Compare registered queries with their SQL in DuckDB: python -m tests.oracle [sf_dir] [:module | name...]"""

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}" if abs(x) >= 1e-9 else "0"
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if type(x).__name__ == "Decimal":
        return f"{float(x):.6g}"
    return str(x)


def from_duckdb(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def differences(spark, sf_dir, query, sql):
    """None if equal; else a short account."""
    df = query(spark, sf_dir)
    names, rows = from_duckdb(sf_dir, sql)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    order = sorted(names)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in rows)
    if got != want:
        odd = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:2]
        return f"{len(got)} / {len(want)} rows; {order}; first odd {odd}"
    return None if got else "no rows"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    q, s = e.queries(), e.oracle_sql()
    module = sys.argv[2][1:] if len(sys.argv) == 3 and sys.argv[2][0] == ":" else None
    for name in [n for n in q if n in s and q[n].__module__.endswith(module)] if module else sys.argv[2:] or [n for n in q if n in s]:
        t = time.time()
        try:
            d = differences(spark, sf, q[name], s[name])
        except Exception as x:  # noqa: BLE001
            d = f"{type(x).__name__}: {str(x)[:600]}"
        print("ok  " if d is None else "BAD ", name, f"{time.time() - t:.1f}s", d or "", flush=True)
