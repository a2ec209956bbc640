"""Runs queries and their SQL on one folder of tables and compares rows. python -m tests.compare DIR [NAME...]"""

import math
import os
import sys

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(normal(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    if got == want:
        return ""
    a, b = set(got[1]), set(want[1])
    return f"columns {got[0]} {want[0]}, rows {len(got[1])} {len(want[1])}, only here {sorted(a - b, key=repr)[:2]}, only SQL {sorted(b - a, key=repr)[:2]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, oracle = connect(sys.argv[1]), e.queries(), e.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or [n for n in oracle]:
        try:
            said = compare(spark, con, sys.argv[1], qs[name], oracle[name])
        except Exception as ex:
            said = f"{type(ex).__name__}: {str(ex)[:600]}"
        bad += bool(said)
        print(name, said[:900] or "ok", flush=True)
    print("bad", bad)
