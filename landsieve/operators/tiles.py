"""Map-tile assignment and thinning of crowded tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landsieve import constants as K
from landsieve.session import materialize


def tile_assign(parcels: DataFrame, lon: str, lat: str, zooms: range = range(K.TILE_MIN_ZOOM, K.TILE_MAX_ZOOM + 1)) -> DataFrame:
    """One row per parcel and zoom with web-mercator tile numbers; only id, apn, acres kept."""
    n = F.pow(F.lit(2.0), F.col("zoom").cast("double"))
    rad = F.radians(F.col(lat))
    fx = (F.col(lon) + 180.0) / 360.0 * n
    fy = (F.lit(1.0) - F.asinh(F.tan(rad)) / F.lit(math.pi)) / 2.0 * n
    return (
        parcels.select("id", "apn", "acres", lon, lat)
        .withColumn("zoom", F.explode(F.array(*[F.lit(z) for z in zooms])))
        .select("id", "apn", "acres", "zoom", F.floor(fx).alias("tile_x"), F.floor(fy).alias("tile_y")))


#: Steps of the curve per axis, as a power of two: cells of about 10 m.
CURVE_BITS = 22
#: Gap of the first point of a tile.
APART = 1 << 62


def curve_position(lon: Column, lat: Column) -> Column:
    """Place on the Z-order curve over the web-mercator square; a tile of any zoom is one stretch of it."""
    n = float(1 << CURVE_BITS)
    fx = F.floor((lon + 180.0) / 360.0 * n)
    fy = F.floor((F.lit(1.0) - F.asinh(F.tan(F.radians(lat))) / F.lit(math.pi)) / 2.0 * n)

    def spread(v):
        """The bits of a number, each followed by a free one."""
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(fx).bitwiseOR(F.shiftleft(spread(fy), 1))


def with_gaps(points: DataFrame, position: str, tie: str) -> DataFrame:
    """Add ``before``, the position of the point before along the curve (NULL for the first).

    Points are range-partitioned along the curve and each partition looks at itself; what precedes a partition is read
    from a table with one row for each.
    """
    placed = materialize(points.repartitionByRange(position, tie).withColumn("_part", F.spark_partition_id()), "curve")
    ends = placed.groupBy("_part").agg(F.max(position).alias("_end"))
    last = F.max("_end").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    own = F.lag(position).over(Window.partitionBy("_part").orderBy(position, tie))
    return placed.withColumn("before", own).join(F.broadcast(ends.select("_part", last.alias("_last"))), "_part").withColumn(
        "before", F.coalesce("before", "_last")).drop("_part", "_last")


def tile_thin(parcels: DataFrame, lon: str, lat: str, per_tile: int,
              zooms: range = range(K.TILE_MIN_ZOOM, K.TILE_MAX_ZOOM + 1)) -> DataFrame:
    """Tiles of parcels, the densest points of a tile that is too full left out.

    A point's gap is its distance along the curve to the point before it in its tile. Points with the smallest gaps go
    first, until the tile fits; of equal gaps the higher id goes. Gaps are the same at all zooms, so they are found once,
    and the literal rank bound lets every task drop the rest before the shuffle.
    """
    there = parcels.select("id", "apn", "acres", F.col(lon).alias("_lon"), F.col(lat).alias("_lat")).filter(
        F.col("_lon").isNotNull() & F.col("_lat").isNotNull())
    gaps = with_gaps(there.withColumn("_at", curve_position(F.col("_lon"), F.col("_lat"))), "_at", "id")
    step = (F.lit(CURVE_BITS) - F.col("zoom")) * 2
    tile = lambda c: F.call_function("shiftright", F.col(c), step.cast("int"))
    gap = F.when(tile("_at") == tile("before"), F.col("_at") - F.col("before")).otherwise(F.lit(APART).cast("long"))
    n = F.pow(F.lit(2.0), F.col("zoom").cast("double"))
    tiles = gaps.withColumn("zoom", F.explode(F.array(*[F.lit(z) for z in zooms]))).withColumn("gap", gap)
    fy = (F.lit(1.0) - F.asinh(F.tan(F.radians("_lat"))) / F.lit(math.pi)) / 2.0 * n
    w = Window.partitionBy("zoom", "tile_x", "tile_y").orderBy(F.desc("gap"), F.asc("id"))
    return tiles.select("id", "apn", "acres", "zoom", F.floor((F.col("_lon") + 180.0) / 360.0 * n).alias("tile_x"), F.floor(fy).alias("tile_y"),
                        "gap").withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= per_tile)
