"""Stable dense ids and space-filling order without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landsieve.functions import geometry as G
from landsieve.session import materialize


def ordered_id(df: DataFrame, keys: list, name: str = "id") -> DataFrame:
    """Dense 1-based ids in the order of ``keys`` (which should be unique).

    Rows are range-partitioned and sorted in parallel, written once with their
    place in the partition, and numbered from the partition counts, a table
    with one row per partition.
    """
    order = [F.expr(k) if isinstance(k, str) else k for k in keys]
    placed = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_start", before).select("_part", "_start")
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_pos") + 1).drop(
        "_part", "_pos", "_start")


def layer_extent(df: DataFrame) -> DataFrame:
    b = F.col("bbox")
    return df.agg(F.min(b["xmin"]).alias("xmin"), F.min(b["ymin"]).alias("ymin"),
                  F.max(b["xmax"]).alias("xmax"), F.max(b["ymax"]).alias("ymax"))


def hilbert_key(df: DataFrame, extent) -> DataFrame:
    """Add ``hilbert``: position of each box centre on the curve over ``extent``."""
    b = F.col("bbox")
    x, y = (b["xmin"] + b["xmax"]) / 2.0, (b["ymin"] + b["ymax"]) / 2.0
    return df.withColumn("hilbert", G.hilbert(x, y, *[float(v) for v in extent]))


def spatial_order(df: DataFrame, tie: str = "id") -> DataFrame:
    """Rows laid out along a Hilbert curve, so that files cover compact areas.

    Left as it is when the extent has no width or height.
    """
    x0, y0, x1, y1 = layer_extent(df).first()
    if x0 is None or x1 <= x0 or y1 <= y0:
        return df
    return hilbert_key(df, (x0, y0, x1, y1)).repartitionByRange("hilbert", tie).sortWithinPartitions("hilbert", tie)


def write_ordered(df: DataFrame, path: str, rows_per_file: int = 1_000_000, tie: str = "id", extent=None) -> DataFrame:
    """Write rows (with ``bbox``) along the curve, ``rows_per_file`` to a file, and return what each file covers.

    Places along the curve come from a parallel range sort, so where files are cut depends on the rows alone.
    """
    extent = extent or layer_extent(df).first()
    flat = extent[0] is None or extent[2] <= extent[0] or extent[3] <= extent[1]
    keyed = df.withColumn("hilbert", F.lit(0).cast("long")) if flat else hilbert_key(df, extent)
    placed = ordered_id(keyed, ["hilbert", tie], "place").withColumn("file", F.floor((F.col("place") - 1) / rows_per_file))
    placed.repartition("file").sortWithinPartitions("file", "place").write.mode("overwrite").partitionBy("file").parquet(path)
    # the rows as they were placed say what each file covers; to open every file again would cost more than writing it
    return file_boxes(placed)


def file_boxes(written: DataFrame) -> DataFrame:
    """What each file covers: file, n_rows, its first and last place on the curve, and the box of its features."""
    b = F.col("bbox")
    return written.groupBy(F.col("file").cast("long").alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("hilbert").alias("first"), F.max("hilbert").alias("last"), F.min(b["xmin"]).alias("xmin"),
        F.min(b["ymin"]).alias("ymin"), F.max(b["xmax"]).alias("xmax"), F.max(b["ymax"]).alias("ymax"))


def files_in_box(boxes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Files whose features may meet a box."""
    x0, y0, x1, y1 = box
    return boxes.filter((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))
