"""Build checks as rows: (check, severity, ok, detail)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landsieve import constants as K

SCHEMA = "check string, severity string, ok boolean, detail string"


class BuildError(RuntimeError):
    """A check of severity ``error`` failed."""


def layer_counts(layers: Mapping[str, DataFrame]) -> DataFrame:
    """(layer, features) of every layer given."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.count("*").alias("features")).select(F.lit(name).alias("layer"), "features") for name, df in layers.items()])


def require_tables(spark: SparkSession, layers: Mapping[str, DataFrame], required: list[str] | None = None) -> DataFrame:
    """Every core layer exists; parcels are not empty; other empty ones only warn."""
    need = required or K.REQUIRED_LAYERS
    here = {n: layers[n] for n in need if n in layers}
    rows = [(f"exists:{n}", "error", n in here, "present" if n in here else "missing") for n in need]
    exists = spark.createDataFrame(rows, SCHEMA)
    if not here:
        return exists
    filled = layer_counts(here).select(
        F.concat(F.lit("not_empty:"), "layer").alias("check"),
        F.when(F.col("layer") == "parcels", "error").otherwise("warning").alias("severity"),
        (F.col("features") > 0).alias("ok"), F.concat("features", F.lit(" rows")).alias("detail"))
    return exists.unionByName(filled)


def nonzero_after_clip(name: str, clipped: DataFrame) -> DataFrame:
    return clipped.agg(F.count("*").alias("n")).select(
        F.lit(f"nonzero_after_clip:{name}").alias("check"), F.lit("error").alias("severity"),
        (F.col("n") > 0).alias("ok"), F.concat("n", F.lit(" rows")).alias("detail"))


def raster_nonzero(stats: DataFrame) -> DataFrame:
    ok = (F.col("valid_cells") > 0) & (F.col("width") >= 2) & (F.col("height") >= 2)
    return stats.select(F.lit("raster_nonzero").alias("check"), F.lit("error").alias("severity"), ok.alias("ok"),
                        F.concat("valid_cells", F.lit(" valid cells")).alias("detail"))


def schema_check(spark: SparkSession, name: str, layer: DataFrame) -> DataFrame:
    missing = [c for c in ("bbox", "geometry") if c not in layer.columns]
    return spark.createDataFrame([(f"schema:{name}", "warning", not missing, ",".join(missing) or "bbox and geometry present")], SCHEMA)


def crs_check(raster_meta: DataFrame, metric: int = K.CRS_METRIC_UTM) -> DataFrame:
    return raster_meta.select(
        F.concat(F.lit("crs:"), "role").alias("check"), F.lit("error").alias("severity"),
        (F.col("crs_epsg") == metric).alias("ok"), F.concat(F.lit("EPSG:"), "crs_epsg").alias("detail"))


def enforce(checks: DataFrame) -> DataFrame:
    """Raise on failed errors, naming all of them; return the warnings. Checks are as few as the layers."""
    failed = checks.filter((F.col("severity") == "error") & ~F.coalesce("ok", F.lit(False))).orderBy("check").collect()
    if failed:
        raise BuildError("; ".join(f"{r['check']}: {r['detail']}" for r in failed))
    return checks.filter(~F.col("ok"))


def distinct_zones(flood: DataFrame) -> DataFrame:
    """Number of distinct flood zone codes."""
    return flood.agg(F.countDistinct(F.upper(F.trim("fld_zone"))).alias("zones"))


def with_coordinates(points: DataFrame, needed: list[str]) -> DataFrame:
    """Points that have their coordinates and values."""
    return points.dropna(subset=needed)


#: Decimal digits past the point in which values are summed, and the size from which they are not.
SUM_DIGITS, SUM_LIMIT = 20, 1e8


def grid_mean(grid: DataFrame) -> DataFrame:
    """Mean of the solar grid, the same however its rows are dealt out.

    A sum of doubles depends on the order of its rows, by enough to move a mean that lies on a rounding tie. Values are
    summed as decimals instead, without error; a grid with a value that such a decimal can't hold has the plain mean.
    """
    v = F.col("avg_ghi").cast("double")
    exact = F.when(F.abs(v) < SUM_LIMIT, v.cast(f"decimal(28,{SUM_DIGITS})"))
    held = F.coalesce(exact.cast("double") == v, F.lit(False))
    mean = F.try_divide(F.sum(exact).cast("double"), F.count(exact))
    return grid.agg(F.when(F.bool_and(F.when(v.isNotNull(), held)), mean).otherwise(F.avg(v)).alias("mean_ghi"))
