"""Lookups with errors, ordered files that a box can skip, and limits of result files."""

import pytest
from pyspark.sql import functions as F

from landsieve.operators import ordering as O
from landsieve.operators import results as RS
from landsieve.sources import writers as W


def boxes(spark, n):
    side = int(n ** 0.5)
    x, y = F.col("id") % side, F.floor(F.col("id") / side)
    return spark.range(n).select("id", F.struct(x.cast("double").alias("xmin"), y.cast("double").alias("ymin"), (x + 0.5).alias("xmax"), (y + 0.5).alias("ymax")).alias("bbox"))


def test_lookup_names_missing_parcels(spark):
    parcels = spark.range(5).withColumn("x", F.lit(1.0))
    wanted = spark.createDataFrame([(1, 3), (2, 9), (3, None), (4, 3)], "ask int, id long")
    got = {r["ask"]: (r["x"], r["error"]) for r in RS.parcel_lookup(parcels, wanted).collect()}
    assert got == {1: (1.0, None), 4: (1.0, None), 2: (None, RS.NOT_FOUND), 3: (None, RS.NOT_FOUND)}
    with pytest.raises(LookupError, match="9"):
        RS.parcel_lookup(parcels, wanted, strict=True)
    assert RS.parcel_lookup(parcels, wanted.filter("id = 3"), strict=True).count() == 2


def test_a_small_box_skips_most_files(spark, tmp_path):
    """A box of one percent of the area touches under five percent of the files, and they hold all its features."""
    df, path = boxes(spark, 40_000), str(tmp_path / "files")
    files = O.write_ordered(df, path, 200)
    rows = files.collect()
    assert sum(r["n_rows"] for r in rows) == 40_000 and all(r["n_rows"] == 200 for r in rows) and len(rows) == 200
    ends = sorted((r["first"], r["last"]) for r in rows)
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    box = (64.0, 64.0, 83.0, 83.0)
    hit = [r["file"] for r in O.files_in_box(files, box).select("file").collect()]
    assert 0 < len(hit) < 0.05 * len(rows) + 1
    b = F.col("bbox")
    inside = (b["xmin"] <= box[2]) & (b["xmax"] >= box[0]) & (b["ymin"] <= box[3]) & (b["ymax"] >= box[1])
    back = spark.read.parquet(path)
    assert back.filter(inside & F.col("file").isin(hit)).count() == df.filter(inside).count()


def test_files_without_extent(spark, tmp_path):
    one = boxes(spark, 1)
    assert O.write_ordered(one, str(tmp_path / "one"), 10).first()["n_rows"] == 1
    assert O.write_ordered(one.filter("id > 5"), str(tmp_path / "none"), 10).count() == 0


def test_result_file_refuses_more_than_a_request(spark, tmp_path):
    with pytest.raises(ValueError, match="at most"):
        W.write_results_csv(spark.range(1001).withColumn("rank", F.col("id")), str(tmp_path / "csv"))
