"""Run queries in Spark and their reference SQL in DuckDB and compare.

    python -m suite.check /root/testdata/sf0.01 [key ...]
"""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9) + 0.0)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, key, fn, sql):
    t = time.time()
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    sec = time.time() - t
    if sql is None:
        return "rows-only", sec, f"{len(got)} rows"
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    a, b = table(df.columns, got), table(cols, cur.fetchall())
    if a == b:
        return "ok", sec, f"{len(got)} rows"
    if a[0] != b[0]:
        return "COLUMNS", sec, f"{a[0]} vs {b[0]}"
    sa, sb = set(a[1]), set(b[1])
    return "DIFF", sec, f"{len(a[1])} vs {len(b[1])} rows; spark-only {list(sa - sb)[:2]} oracle-only {list(sb - sa)[:2]}"


def main():
    from landsieve.session import build_session
    from suite.catalog import ORACLE, QUERIES

    sf, keys = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                         "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for key in keys or QUERIES:
        try:
            status, sec, note = compare(spark, con, sf, key, QUERIES[key], ORACLE.get(key))
        except Exception as err:  # report and go on with the next query
            status, sec, note = "ERROR", 0.0, str(err).replace("\n", " ")[:600]
        bad += status not in ("ok", "rows-only")
        print(f"{status:10s} {sec:6.2f}s {key}: {note}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
