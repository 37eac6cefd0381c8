"""Compare a query with its DuckDB SQL: python tests/oracle.py SF NAME..."""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def frames(spark, name, sf_dir):
    import __spark_entry__ as e

    got = e.queries()[name](spark, sf_dir).toPandas()
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return got, con.sql(e.oracle_sql()[name]).df()


def differences(got, want) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} and {len(want)}"
    cols = sorted(got.columns)

    def rows(df):
        out = []
        for r in df[cols].itertuples(index=False):
            out.append(tuple("null" if v is None or pd.isna(v) else (format(float(v), ".6g") if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iufb" else str(v)) for v in r))
        return sorted(out)

    a, b = rows(got), rows(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]} of {cols}" if bad else ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as e

    for name in sys.argv[2:] or list(e.oracle_sql()):
        began = time.time()
        try:
            found = differences(*frames(spark, name, f"/root/testdata/{sys.argv[1]}"))
        except Exception as x:  # noqa: BLE001
            found = f"{type(x).__name__}: {str(x)[:1500]}"
        print(f"{name}: {found or 'equal'} ({time.time() - began:.1f} s)", flush=True)
