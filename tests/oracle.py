"""Compare every query with its SQL in DuckDB: python tests/oracle.py [sf_dir] [name prefix]."""

import math
import os
import sys
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    a, b = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows differ: {bad[0]}" if bad else ""


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, prefix = (sys.argv[1:2] or ["/root/testdata/sf0.001"])[0], (sys.argv[2:3] or [""])[0]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, good = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if not name.startswith(tuple(prefix.split(","))) or (not prefix and name.startswith(("op", "pipeline"))):
            continue
        try:
            said = compare(spark, con, query, sql[name], sf_dir) if name in sql else "" if query(spark, sf_dir).count() >= 0 else "x"
        except Exception:
            said = traceback.format_exc()[-500:] if "JVM" not in (t := traceback.format_exc()) else t.split("\n\nJVM")[0][-600:]
        good += not said
        if said:
            print("BAD", name, said[:700])
    print(good, "good")
