"""Run named queries and their SQL side by side: ``python tests/check_queries.py FOLDER [name ...]``."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def oracle_rows(sf_dir, sql):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, [str(d[1]) for d in got.description], got.fetchall()


def _key(row):
    return tuple(("~" if v is None else f"{type(v).__name__}:{v}") for v in row)


def compare(spark, sf_dir, query, sql):
    """None when both sides agree, else a short text."""
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if rows else "no rows"
    names, kinds, expected = oracle_rows(sf_dir, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    spark_kinds = dict(df.dtypes)
    wrong = [(n, spark_kinds[n], k) for n, k in zip(names, kinds)
             if {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN"}[spark_kinds[n]] not in k]
    if wrong:
        return f"types {wrong}"
    left = sorted(_key([r[df.columns.index(n)] for n in order]) for r in rows)
    right = sorted(_key([r[names.index(n)] for n in order]) for r in expected)
    if left != right:
        a, b = set(left) - set(right), set(right) - set(left)
        return f"{len(left)} vs {len(right)} rows; only Spark: {sorted(a)[:2]}; only SQL: {sorted(b)[:2]}"
    return None


def main():
    from pyspark.sql import SparkSession
    from __spark_entry__ import oracle_sql, queries
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    sql = oracle_sql()
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = compare(spark, sf_dir, query, sql.get(name))
        except Exception as exc:  # report and go on with the other queries
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        print(f"{'OK ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s "
              f"{'' if problem is None else problem}", flush=True)


if __name__ == "__main__":
    main()
