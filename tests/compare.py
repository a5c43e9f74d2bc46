"""Run queries and their SQL side by side: python tests/compare.py SF_DIR [NAME...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def views(con, d):
    for f in sorted(os.listdir(d)):
        path = os.path.join(d, f)
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if isinstance(x, float):
            return "NaN" if x != x else f"{x:.9g}"
        if isinstance(x, (list, tuple)):
            return tuple(cell(y) for y in x)
        return str(x)

    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=str)


def same(spark, con, name, query, sql, d):
    began = time.time()
    df = query(spark, d)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - began
    if sql is None:
        return "rows only", len(got), took
    result = con.execute(sql)
    want = rows([c[0] for c in result.description], result.fetchall())
    if sorted(df.columns) != sorted(c[0] for c in result.description):
        return f"columns {df.columns} {[c[0] for c in result.description]}", len(got), took
    if got == want:
        return "same", len(got), took
    extra, missing = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
    return f"DIFFER got {len(got)} want {len(want)} extra {extra} missing {missing}", len(got), took


if __name__ == "__main__":
    import duckdb
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "/tmp/ck").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    views(con, sys.argv[1])
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        try:
            print(name, *same(spark, con, name, queries[name], sql.get(name), sys.argv[1]), flush=True)
        except Exception as e:  # noqa: BLE001
            print(name, "ERROR", str(e)[:600], flush=True)
