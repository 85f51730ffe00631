"""Derived parcel columns from the other layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landsieve import constants as K
from landsieve.functions import geometry as G
from landsieve.functions.projection import add_lonlat, add_utm, utm_point
from landsieve.operators.joins import lookup_join
from landsieve.operators.queue import poi_collapse
from landsieve.operators.spatial import (meeting, nearest_line, nearest_point, polygon_columns, smallest_container)
from landsieve.session import materialize

ZONE_CELL = 0.05
OVERLAY_CELL = 0.02


def metric_parts(parts: Column) -> Column:
    return G.map_points(parts, utm_point)


def with_centroids(parcels: DataFrame) -> DataFrame:
    """Centroid of the metric polygon (mx, my) and its lon/lat (clon, clat)."""
    c = G.centroid(metric_parts(F.col("parts")))
    out = parcels.withColumn("_c", c).withColumn("mx", F.col("_c.x")).withColumn("my", F.col("_c.y")).drop("_c")
    return add_lonlat(out, "mx", "my", "clon", "clat")


def with_metric_point(df: DataFrame, lon: str, lat: str) -> DataFrame:
    return add_utm(df, lon, lat, "mx", "my")


def nearest_substation(cent: DataFrame, subs: DataFrame) -> DataFrame:
    """id, sub_id, nearest_sub_kv, dist_sub_m; ties by station id."""
    n = nearest_point(cent, subs.select(F.col("id").alias("sub_id"), "max_voltage_kv", "mx", "my"),
                      "id", "mx", "my", "mx", "my", "sub_id", ["max_voltage_kv"])
    return n.select("id", "sub_id", F.col("max_voltage_kv").alias("nearest_sub_kv"), F.col("dist").alias("dist_sub_m"))


def nearest_line_distance(cent: DataFrame, lines: DataFrame, line: str = "line") -> DataFrame:
    return nearest_line(cent, lines, "id", "mx", "my", "line_id", line).select("id", F.col("dist").alias("dist_tx_m"))


def nearest_ghi(cent: DataFrame, grid: DataFrame) -> DataFrame:
    n = nearest_point(cent, grid.select(F.col("id").alias("ghi_id"), "avg_ghi", "mx", "my"),
                      "id", "mx", "my", "mx", "my", "ghi_id", ["avg_ghi"])
    return n.select("id", F.col("avg_ghi").alias("ghi"))


def nearest_generator(cent: DataFrame, generators: DataFrame) -> DataFrame:
    n = nearest_point(cent, generators.select(F.col("id").alias("gen_id"), "mx", "my"),
                      "id", "mx", "my", "mx", "my", "gen_id", [])
    return n.select("id", F.col("dist").alias("eia_nearest_m"))


def flood_flag(parcels: DataFrame, flood: DataFrame, cell: float = OVERLAY_CELL) -> DataFrame:
    """id of each parcel that meets a flood polygon, with sfha_flag true."""
    return meeting(parcels, flood.select("bbox", "edges", "anchors"), cell).withColumn("sfha_flag", F.lit(True))


def overlay_flags(parcels: DataFrame, exclusions: DataFrame | None, cell: float = OVERLAY_CELL) -> DataFrame:
    """id with one flag per exclusion kind, for parcels that meet any."""
    hits, known = None, F.coalesce(F.col("kind").isin(K.EXCLUSION_KINDS), F.lit(False))
    groups = {kind: exclusions.filter(F.col("kind") == kind) for kind in K.EXCLUSION_KINDS}
    others = exclusions.filter(~known)
    # areas of other kinds set no flag, but a parcel that meets one has its row
    for kind, areas in (groups if others.isEmpty() else groups | {"": others}).items():
        own = meeting(parcels, areas.select("bbox", "edges", "anchors"), cell).withColumn("kind", F.lit(kind))
        hits = own if hits is None else hits.unionByName(own)
    return hits.groupBy("id").agg(*[F.max(F.col("kind") == k).alias(f"excl_{k}") for k in K.EXCLUSION_KINDS])


def zoning_at_point(cent: DataFrame, zoning: DataFrame, cell: float = ZONE_CELL) -> DataFrame:
    """Zone of the smallest polygon strictly containing the stored centroid."""
    z = zoning.withColumn("zone_area", G.area(F.col("parts"))).withColumnRenamed("id", "zone_id")
    return smallest_container(cent, z, cell, "clon", "clat", "id", "zone_area", "zone_id", ["zone_code"]).select(
        "id", F.col("zone_code").alias("zoning_class"))


def competition_attach(nearest: DataFrame, competition: DataFrame) -> DataFrame:
    one = poi_collapse(competition).select(
        F.col("substation_id").alias("sub_id"), F.col("mw_within_radius").alias("poi_competition_mw"),
        F.col("n_within_radius").alias("poi_competition_n"))
    return lookup_join(nearest, one, ["sub_id"])


def update_from(base: DataFrame, values: DataFrame, key: str = "id") -> DataFrame:
    """Replace or add the columns of ``values`` by key; every base row stays once."""
    fresh = [c for c in values.columns if c != key]
    return base.drop(*[c for c in fresh if c in base.columns]).join(values, key, "left")


def enrich_assemble(parcels: DataFrame, substations: DataFrame, lines: DataFrame, grid: DataFrame,
                    flood: DataFrame | None = None, zoning: DataFrame | None = None, competition: DataFrame | None = None,
                    exclusions: DataFrame | None = None, generators: DataFrame | None = None,
                    slope: DataFrame | None = None) -> DataFrame:
    """All derived columns, every parcel exactly once."""
    # Seven steps read the parcels with their centroids: derive them once.
    p = materialize(with_centroids(polygon_columns(parcels)), "centroids")
    cent = p.select("id", "mx", "my", "clon", "clat")
    return assemble(p, cent, substations, lines, grid, flood, zoning, competition, exclusions, generators, slope).drop(
        "sub_id", "edges", "anchors")


def assemble(p: DataFrame, cent: DataFrame, substations: DataFrame, lines: DataFrame, grid: DataFrame,
             flood: DataFrame | None = None, zoning: DataFrame | None = None, competition: DataFrame | None = None,
             exclusions: DataFrame | None = None, generators: DataFrame | None = None,
             slope: DataFrame | None = None) -> DataFrame:
    """All derived columns and ``sub_id`` beside the polygons ``p``, whose centres are ``cent``.

    The parts are all keyed by parcel id, so the joins that put them together
    share one partitioning of the parcel table.
    """
    near = nearest_substation(cent, substations)
    if competition is not None:
        near = competition_attach(near, competition)
    else:
        near = near.withColumn("poi_competition_mw", F.lit(None).cast("double")).withColumn("poi_competition_n", F.lit(None).cast("long"))
    out = p.join(near, "id", "left")
    out = out.join(nearest_line_distance(cent, lines), "id", "left").join(nearest_ghi(cent, grid), "id", "left")
    if generators is not None:
        out = out.join(nearest_generator(cent, generators), "id", "left")
    else:
        out = out.withColumn("eia_nearest_m", F.lit(None).cast("double"))
    if flood is not None:
        out = out.join(flood_flag(p, flood), "id", "left")
    else:
        out = out.withColumn("sfha_flag", F.lit(False))
    if exclusions is not None:
        out = out.join(overlay_flags(p, exclusions), "id", "left")
    else:
        for k in K.EXCLUSION_KINDS:
            out = out.withColumn(f"excl_{k}", F.lit(False))
    if zoning is not None:
        out = out.join(zoning_at_point(cent, zoning), "id", "left")
    else:
        out = out.withColumn("zoning_class", F.lit(None).cast("string"))
    if slope is not None:
        out = out.join(slope, "id", "left")
    else:
        out = out.withColumn("mean_slope_pct", F.lit(None).cast("double")).withColumn("mean_slope_pct_final", F.lit(None).cast("double"))
    for c in ["sfha_flag", *[f"excl_{k}" for k in K.EXCLUSION_KINDS]]:
        out = out.withColumn(c, F.coalesce(c, F.lit(False)))
    return out


def enrich_summary(parcels: DataFrame) -> DataFrame:
    return parcels.agg(
        F.count("*").alias("parcels"), F.count("mean_slope_pct").alias("with_slope"),
        F.count("zoning_class").alias("zoning_classified"), F.count_if("sfha_flag").alias("sfha_parcels"))
