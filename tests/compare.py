"""Run catalogue queries on Spark and their SQL twins on DuckDB and compare the results.

    python tests/compare.py [sf_dir] [name ...]
"""

import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for table in TABLES:
        if (Path(sf_dir) / f"{table}.parquet").exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


# Spark and DuckDB names of the types the catalogue uses.
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP"}


def compare(spark, con, name, query, sql, sf_dir):
    """Error text, or '' when both engines agree."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return "" if got[1] else "no rows"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    want = rows_of(names, cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    mismatched = {c: (t, kinds[c]) for c, t in df.dtypes if TYPES.get(t, t) != kinds[c]}
    if mismatched:
        return f"types {mismatched}"
    if got[1] != want[1]:
        left, right = set(map(repr, got[1])), set(map(repr, want[1]))
        return (f"{len(got[1])} rows != {len(want[1])} rows; only Spark {sorted(left - right)[:3]}; "
                f"only SQL {sorted(right - left)[:3]}")
    return "" if want[1] else "empty on both sides"


def session():
    from pyspark.sql import SparkSession
    spark = (
        SparkSession.builder.master("local[8]").appName("weblode-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            error = compare(spark, con, name, queries[name], oracles.get(name), sf)
        except Exception as exc:  # report and go on with the next query
            error = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += bool(error)
        print(f"{'FAIL' if error else 'ok  '} {name:28s} {time.time() - start:6.2f}s {'rows only' if name not in oracles else ''} {error}", flush=True)
    print("failed:", bad)
