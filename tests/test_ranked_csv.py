"""All ranked rows in files that follow one another."""

from pyspark.sql import functions as F

from landsieve.sources import writers as W
from suite.q_sources import write_results_csv


def test_files_follow_one_another(spark, tmp_path):
    names = [f for f in W.csv_header().lstrip("﻿").split(",") if f not in ("rank", "id", "apn")]
    df = spark.range(5000).withColumn("rank", 5000 - F.col("id")).withColumn("apn", F.lit('=a,"b"'))
    for n in names:
        df = df.withColumn(n, F.lit("A") if n == "zoning_class" else F.lit(True) if n == "sfha_flag" else F.col("id") / 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    W.write_ranked_csv(df, str(tmp_path / "csv"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted((tmp_path / "csv").glob("part-*"))
    text = b"".join(f.read_bytes() for f in files).decode("utf-8")
    lines = text.split("\r\n")
    assert len(files) > 1 and text.startswith("﻿rank,id,apn,") and text.count("﻿") == 1 and lines[-1] == ""
    assert [int(x.split(",")[0]) for x in lines[1:-1]] == list(range(1, 5001))
    assert lines[1].startswith('1,4999,"\'=a,""b""",')


def test_query_writes_every_parcel(spark):
    n = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert n > 1000 and write_results_csv(spark, "/root/testdata/sf0.001").count() == n + 1
