"""Compare registered queries with their SQL on DuckDB: ``python tests/compare.py [sf_dir] [name...]``."""

import math
import sys
from collections import Counter
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def clean(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, bool):
            return v
        return float(f"{float(v):.9g}") if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else v

    return [columns[i] for i in order], Counter(tuple(clean(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def compare(spark, con, sf_dir, query, sql):
    """None if both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    want = con.execute(sql)
    want = rows_of([d[0] for d in want.description], want.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return None
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    return f"{sum(got[1].values())} and {sum(want[1].values())} rows; only in Spark {list((got[1] - want[1]).items())[:3]}; only in SQL {list((want[1] - got[1]).items())[:3]}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parents[1]))
    from pyspark.sql import SparkSession

    from augury import registry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(folder), registry.oracle_sql()
    for name, query in registry.queries().items():
        if len(sys.argv) > 2 and not any(x in name for x in sys.argv[2:]):
            continue
        try:
            found = compare(session, con, folder, query, sqls[name]) if name in sqls else f"rows only: {query(session, folder).count()}"
        except Exception as e:
            found = f"{type(e).__name__}: {str(e)[:400]}"
        print("ok  " if found is None else "DIFF", name, found or "", flush=True)
