"""Compare registered queries with their SQL: rows, column names and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(cell(x) for x in v.values())
    if hasattr(v, "asDict"):
        return tuple(cell(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if type(v).__name__ == "Decimal":
        return repr(float(v))
    return v


def normalized(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(cell(r[i]) for i in order)) for r in rows)


def difference(spark, con, query, sf_dir):
    df = query.run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(query.sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    a, b = normalized(df.columns, got), normalized(names, want)
    if a == b:
        return None, len(got)
    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return f"{len(a)} vs {len(b)} rows; spark-only {only_a} sql-only {only_b}", len(got)


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from pyspark.sql import SparkSession

    from veinstone.registry import all_queries
    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(f"/root/testdata/{sf}")
    for query in all_queries():
        if only and query.name not in only:
            continue
        t = time.time()
        try:
            if query.sql is None:
                rows = query.run(spark, f"/root/testdata/{sf}").collect()
                print(f"ROWS {query.name} {len(rows)} {time.time() - t:.1f}s", flush=True)
            else:
                diff, n = difference(spark, con, query, f"/root/testdata/{sf}")
                print(f"{'OK  ' if diff is None else 'DIFF'} {query.name} {n} {time.time() - t:.1f}s"
                      f" {(diff or '')[:700]}", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {query.name} {type(e).__name__} {str(e)[:700]}", flush=True)
