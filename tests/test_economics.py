"""Rounding of price changes against DuckDB."""

import duckdb
from pyspark.sql import functions as F

from landsieve.operators import economics as EC


def test_change_is_rounded_as_sql_does(spark):
    pairs = [(k, 2000 + 400 * (k % 3), 1393 + k) for k in range(400)]
    series = spark.createDataFrame([r for k, a, b in pairs for r in ((k, "2020-01-01", float(a)), (k, "2021-01-01", float(b)))],
                                   "county int, date string, value double")
    got = {r.county: r.yoy_pct for r in EC.price_yoy(series).collect()}
    con = duckdb.connect()
    values = ", ".join(f"({k}, cast({a} as double), cast({b} as double))" for k, a, b in pairs)
    want = dict(con.execute(f"select k, round((b - a) / nullif(a, 0) * 100.0, 1) from (values {values}) t(k, a, b)").fetchall())
    assert got == want and got[0] == -30.4


def test_blend_is_rounded_as_sql_does(spark):
    pairs = [(16.12086776859504, 0.030303030303030304), (49.6504820936639, 0.9797979797979798), (57.587809917355365, 0.9393939393939394),
             (17.532713498622588, 0.010101010101010102), (50.0, 0.5)]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, score double, share double")
    got = {r.k: r.b for r in rows.select("k", EC.affordability_blend(F.col("score"), F.col("share")).alias("b")).collect()}
    values = ", ".join(f"({k}, cast({a!r} as double), cast({b!r} as double))" for k, (a, b) in enumerate(pairs))
    want = dict(duckdb.connect().execute(f"select k, round(0.88 * a + 0.12 * 100.0 * b, 1) from (values {values}) t(k, a, b)").fetchall())
    assert got == want and got[0] == 14.6
