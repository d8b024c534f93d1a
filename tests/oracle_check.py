"""Run registered queries on Spark and their SQL on DuckDB and compare the results.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def canonical(value):
    import pandas as pd

    if value is None or value is pd.NA or value is pd.NaT:
        return ""
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (float, Decimal)):
        value = float(value)
        if math.isnan(value):
            return ""
        if value == int(value) and abs(value) < 1e15:
            return str(int(value))
        return repr(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dict):
        return str(sorted((k, canonical(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def rows_of(frame):
    names = sorted(frame.columns)
    cols = [frame[n].tolist() for n in names]
    return names, sorted("|".join(canonical(v) for v in row) for row in zip(*cols))


def connect(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads=8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, con, sf, name, query, sql):
    start = time.time()
    df = query(spark, sf)
    left = df.toPandas()
    mid = time.time()
    if sql is None:
        return f"rows {len(left):>8}  spark {mid - start:6.1f}s  (rows only)", len(left) > 0
    right = con.execute(sql).fetch_df()
    end = time.time()
    names, a = rows_of(left)
    names2, b = rows_of(right)
    info = f"rows {len(a):>8}  spark {mid - start:6.1f}s  duckdb {end - mid:6.1f}s"
    if names != names2:
        return f"{info}  COLUMNS {names} vs {names2}", False
    if a == b:
        return info, len(a) > 0
    sa, sb = set(a), set(b)
    return (f"{info}  DIFF {len(a)} vs {len(b)} {names}\n   spark only: {sorted(sa - sb)[:4]}\n"
            f"   sql only:   {sorted(sb - sa)[:4]}"), False


def main():
    import __spark_entry__ as entry
    from inkloom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles, failed = entry.oracle_sql(), []
    queries = entry.queries()
    for name, query in queries.items():
        if wanted and name not in wanted:
            continue
        try:
            text, ok = compare(spark, con, sf, name, query, oracles.get(name))
        except Exception as err:  # keep going so one broken query does not hide the others
            text, ok = f"ERROR {str(err)[:700]}", False
        print(f"{'ok  ' if ok else 'FAIL'} {name:28} {text}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
