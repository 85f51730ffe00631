"""The offline build: raw layers in, one enriched parcel table out.

Every builder is a function of DataFrames; ``run`` wires them in dependency
order, writes each layer once and checks the written tables.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landsieve import constants as K
from landsieve.functions import cleaning as C
from landsieve.functions import geometry as G
from landsieve.functions.projection import reproject, utm_point
from landsieve.operators import enrich as E
from landsieve.operators import quality as Q
from landsieve.operators import queue as QU
from landsieve.operators import raster as R
from landsieve.operators.ordering import ordered_id, spatial_order
from landsieve.operators.repair import geometry_repair
from landsieve.operators.spatial import clip_lines, clip_points, clip_polygons, polygon_columns
from landsieve.session import materialize
from landsieve.sources import readers as S
from landsieve.sources.writers import layer_frame

CLIP_CELL = 0.1


def _polygons(features: DataFrame, crs: int = K.CRS_STORAGE, only: Column | None = None) -> DataFrame:
    """Attributes as columns and ``parts`` in lon/lat, repaired; empty ones dropped.

    ``only`` picks features by their attributes; they are written first, so that no other feature's geometry is read.
    """
    df = S.property_columns(features)
    df = (df if only is None else materialize(df.filter(only), "picked-features")).withColumn("parts", S.parse_polygon(F.col("kind"), F.col("coordinates")))
    if crs not in (K.CRS_STORAGE, K.CRS_SOURCE_NAD83):
        df = df.withColumn("parts", G.map_points(F.col("parts"), lambda x, y: reproject(x, y, crs, K.CRS_STORAGE)))
    df = df.drop("kind", "coordinates").filter(drop_empty_geom())
    return geometry_repair(df).filter("repair <> 'quarantined'").drop("repair")


def drop_empty_geom(parts: str = "parts"):
    return F.col(parts).isNotNull() & (F.size(parts) > 0) & (G.vertex_count(F.col(parts)) > 0)


def build_county(features: DataFrame, state: str = K.STATE_FIPS, county: str = K.COUNTY_FIPS, geoid: str = K.COUNTY_GEOID) -> DataFrame:
    """Exactly one boundary row with the expected id."""
    df = _polygons(features, only=(F.col("STATEFP") == state) & (F.col("COUNTYFP") == county))
    out = polygon_columns(df.select(
        F.col("GEOID").alias("geoid"), F.col("NAME").alias("name"), F.col("STATEFP").alias("statefp"),
        F.col("COUNTYFP").alias("countyfp"), "parts"))
    ids = [r[0] for r in out.select("geoid").limit(2).collect()]
    if ids != [geoid]:
        raise S.SourceError(f"county filter gave {ids}, expected exactly {geoid}")
    return out


def build_parcels(features: DataFrame, apn_field: str | None = None) -> DataFrame:
    df = _polygons(features)
    apn = C.pick_text(df, "apn", required=True, forced=apn_field)
    sized = df.select(apn.alias("apn"), "parts", *[c for c in ("source_file", "pos") if c in df.columns])
    sized = sized.withColumn("apn_norm", C.apn_norm(F.col("apn"))).withColumn("area_sqm", G.area(E.metric_parts(F.col("parts"))))
    keys = [F.col(c) for c in ("source_file", "pos") if c in df.columns] or [F.col("apn"), F.xxhash64("parts")]
    return ordered_id(sized, keys).withColumn("acres", C.acres(F.col("area_sqm"))).select(
        "id", "apn", "apn_norm", "area_sqm", "acres", "parts")


def build_lines(features: DataFrame, boundary: DataFrame) -> DataFrame:
    df = S.property_columns(features).withColumn("lines", S.parse_lines(F.col("kind"), F.col("coordinates"))).filter("size(lines) > 0")
    pick = lambda f: C.pick_text(df, f)
    rows = df.select(
        pick("source_id").alias("source_id"), C.voltage_known(C.num_try(pick("line_voltage"))).alias("voltage_kv"),
        pick("line_class").alias("volt_class"), pick("line_owner").alias("owner"), pick("line_type").alias("line_type"),
        pick("status").alias("status"), F.posexplode("lines").alias("part", "line"),
        F.col("pos"), F.col("source_file") if "source_file" in df.columns else F.lit("").alias("source_file"))
    rows = rows.withColumn("rid", F.xxhash64("source_file", "pos", "part"))
    cut = clip_lines(rows, boundary, CLIP_CELL, "rid", "line")
    whole = cut.groupBy("source_file", "pos").agg(
        *[F.first(c).alias(c) for c in ["source_id", "voltage_kv", "volt_class", "owner", "line_type", "status"]],
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "pieces"))), lambda p: p["pieces"])).alias("pieces"))
    return ordered_id(whole, [F.col("source_file"), F.col("pos")]).drop("source_file", "pos")


def build_substations(features: DataFrame, boundary: DataFrame) -> DataFrame:
    df = S.property_columns(features).withColumn("p", S.parse_point(F.col("kind"), F.col("coordinates"))).filter("p is not null")
    pick = lambda f: C.pick_text(df, f)
    rows = df.select(
        pick("source_id").alias("source_id"), pick("sub_name").alias("name"),
        C.voltage_known(C.num_try(pick("sub_max_voltage"))).alias("max_voltage_kv"),
        C.voltage_known(C.num_try(pick("sub_min_voltage"))).alias("min_voltage_kv"),
        pick("sub_type").alias("sub_type"), pick("status").alias("status"),
        F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("pos"),
        F.col("source_file") if "source_file" in df.columns else F.lit("").alias("source_file"))
    rows = rows.withColumn("rid", F.xxhash64("source_file", "pos"))
    inside = clip_points(rows, boundary, CLIP_CELL, "x", "y", "rid")
    out = ordered_id(inside, [F.col("source_file"), F.col("pos")]).drop("rid", "source_file", "pos")
    return E.with_metric_point(out, "x", "y")


def build_flood(features: DataFrame, boundary: DataFrame) -> DataFrame:
    df = _polygons(features)
    zone, flag = C.pick_text(df, "flood_zone", required=True), C.pick_column(df.columns, K.FIELDS["flood_flag"], "flag", False)
    rows = df.filter(C.is_flood_hazard(zone, F.col(flag) if flag else None)).select(
        C.pick_text(df, "flood_id").alias("source_id"), zone.alias("fld_zone"), C.pick_text(df, "flood_subtype").alias("zone_subtype"),
        "parts", F.xxhash64("source_file", "pos").alias("rid"), "source_file", "pos")
    cut = clip_polygons(rows, boundary, CLIP_CELL, "rid")
    return ordered_id(cut, [F.col("source_file"), F.col("pos")]).select(
        "id", "source_id", "fld_zone", "zone_subtype", F.lit(True).alias("sfha_flag"), "parts")


def build_zoning(features: DataFrame) -> DataFrame:
    df = _polygons(features)
    code = C.pick_text(df, "zone_code", required=True)
    rows = df.select(C.zone_code_norm(code).alias("zone_code"), code.alias("zone_code_raw"),
                     C.pick_text(df, "zone_combined").alias("zone_combined"), C.pick_text(df, "zone_desc").alias("description"),
                     "parts", "source_file", "pos")
    return ordered_id(rows, [F.col("source_file"), F.col("pos")]).drop("source_file", "pos")


def build_general_plan(features: DataFrame) -> DataFrame:
    df = _polygons(features)
    rows = df.select(C.pick_text(df, "gp_desig").alias("gp_desig"), C.pick_text(df, "gp_lu").alias("lu_desc"), "parts", "source_file", "pos")
    return ordered_id(rows, [F.col("source_file"), F.col("pos")]).drop("source_file", "pos")


def build_specific_plans(features: DataFrame) -> DataFrame:
    df = _polygons(features)
    rows = df.select(C.pick_text(df, "sp_name").alias("sp_name"), "parts", "source_file", "pos")
    return ordered_id(rows, [F.col("source_file"), F.col("pos")]).drop("source_file", "pos")


def build_queue(table: DataFrame, substations: DataFrame, county: str = K.COUNTY_NAME) -> DataFrame:
    """``table``: the queue CSV as text columns, in any of the known layouts."""
    pick = lambda f, req=False: C.pick_text(table, f, req)
    rows = table.select(
        pick("queue_id").alias("queue_id"), pick("queue_name").alias("project_name"), pick("queue_type").alias("generation_type"),
        pick("queue_fuel").alias("fuel"), pick("queue_status").alias("status"), C.is_active(pick("queue_status")).alias("is_active"),
        C.num_clean(pick("queue_mw")).alias("capacity_mw"), pick("queue_county", True).alias("county"),
        pick("queue_state").alias("state"), pick("queue_owner").alias("transmission_owner"),
        pick("queue_poi", True).alias("poi_name"), C.voltage_known(C.num_clean(pick("queue_voltage"))).alias("source_voltage_kv"),
        pick("queue_date").alias("queue_date"), pick("queue_done").alias("proposed_completion_date"),
    ).filter(C.mentions_county(F.col("county"), county))
    return ordered_id(QU.match_queue(rows, substations), [F.col("queue_id"), F.col("project_name"), F.xxhash64("poi_name", "capacity_mw", "status")])


def build_grid(table: DataFrame, boundary: DataFrame) -> DataFrame:
    num = lambda f, req=False: C.num_try(C.pick_text(table, f, req))
    rows = table.select(num("grid_lon", True).alias("lon"), num("grid_lat", True).alias("lat"), num("grid_ghi").alias("avg_ghi"),
                        num("grid_dni").alias("avg_dni"), num("grid_tilt").alias("avg_lat_tilt")).dropna(subset=["lon", "lat", "avg_ghi"])
    rows = rows.withColumn("rid", F.xxhash64("lon", "lat", "avg_ghi", "avg_dni", "avg_lat_tilt"))
    out = ordered_id(clip_points(rows, boundary, CLIP_CELL, "lon", "lat", "rid"), [F.col("lat"), F.col("lon"), F.col("rid")]).drop("rid")
    return E.with_metric_point(out, "lon", "lat")


def build_generators(table: DataFrame | None, boundary: DataFrame) -> DataFrame | None:
    if table is None:
        return None
    txt = lambda f, req=False: C.pick_text(table, f, req)
    rows = table.select(
        txt("plant_id").alias("plant_id"), txt("plant_name").alias("name"), C.num_clean(txt("plant_mw")).alias("capacity_mw"),
        txt("plant_fuel").alias("fuel"), txt("plant_status").alias("status"), txt("plant_county").alias("county"),
        C.num_clean(txt("plant_lon", True)).alias("lon"), C.num_clean(txt("plant_lat", True)).alias("lat")).dropna(subset=["lon", "lat"])
    rows = rows.withColumn("rid", F.xxhash64(*rows.columns))
    out = ordered_id(clip_points(rows, boundary, CLIP_CELL, "lon", "lat", "rid"),
                     [F.col("plant_id"), F.col("lat"), F.col("lon"), F.col("rid")]).drop("rid")
    return E.with_metric_point(out, "lon", "lat")


def exclusion_source(kind: str, features: DataFrame) -> DataFrame:
    df = _polygons(features)
    return df.select(F.lit(kind).alias("kind"), C.pick_text(df, "exclusion_id").alias("source_id"),
                     C.pick_text(df, "exclusion_name").alias("name"), "parts", F.xxhash64(F.lit(kind), "source_file", "pos").alias("rid"))


def exclusions_union(kinds: list[DataFrame]) -> DataFrame:
    out = kinds[0]
    for df in kinds[1:]:
        out = out.unionByName(df)
    return out


def build_exclusions(sources: Mapping[str, DataFrame], boundary: DataFrame) -> DataFrame | None:
    if not sources:
        return None
    every = exclusions_union([exclusion_source(k, f) for k, f in sources.items()])
    cut = clip_polygons(every, boundary, CLIP_CELL, "rid")
    return ordered_id(cut, [F.col("kind"), F.col("source_id"), F.col("rid")]).drop("rid")


def build_slope(dem: DataFrame, source: R.Grid, target: R.Grid, boundary: DataFrame, to_source=None) -> DataFrame:
    """Elevation cells (row, col, z) -> masked slope cells on the metric grid."""
    z = R.raster_resample(dem, source, target, to_source)
    slope = R.raster_slope(R.slope_gradient(z, target.rows, target.cols, target.dx, target.dy))
    metric = polygon_columns(boundary.select(E.metric_parts(F.col("parts")).alias("parts")))
    return R.raster_mask(slope, target, metric, max(target.dx * target.cols, target.dy * target.rows) / 16)


def line_layer_metric(lines: DataFrame) -> DataFrame:
    """One row per clipped piece, in metres, for the distance step."""
    to_metric = lambda line: F.transform(line, lambda p: utm_point(p["x"], p["y"]))
    return lines.select(F.col("id").alias("line_id"), F.explode("pieces").alias("line")).withColumn("line", to_metric(F.col("line")))


def run(spark: SparkSession, src: Mapping, out: str) -> dict[str, DataFrame]:
    """Build every layer and the enriched parcels under ``out``.

    ``src`` keys: county, parcels, transmission, substations, flood, zoning,
    general_plan, specific_plans (features); queue, ghi and optional generators
    (text tables); exclusions (kind -> features); and optional dem = (cells,
    source grid, target grid, to_source).
    """
    tables: dict[str, DataFrame] = {}
    checks: list[DataFrame] = []

    def keep(name: str, df: DataFrame | None) -> DataFrame | None:
        if df is None:
            return None
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        tables[name] = spark.read.schema(df.schema).parquet(f"{out}/{name}")
        return tables[name]

    county = keep("county_boundary", build_county(src["county"]))
    parcels = keep("parcels_raw", build_parcels(src["parcels"], src.get("apn_field")))
    lines = keep("transmission_lines", build_lines(src["transmission"], county))
    subs = keep("substations", build_substations(src["substations"], county))
    flood = keep("flood_sfha", polygon_columns(build_flood(src["flood"], county)))
    zoning = keep("zoning", polygon_columns(build_zoning(src["zoning"])))
    keep("general_plan", build_general_plan(src["general_plan"]))
    keep("specific_plans", build_specific_plans(src["specific_plans"]))
    queue = keep("caiso_queue", build_queue(src["queue"], subs))
    comp = keep("poi_competition", QU.poi_competition(queue, subs))
    keep("caiso_queue_summary", QU.queue_summary(queue))
    grid = keep("ghi_grid", build_grid(src["ghi"], county))
    gens = keep("eia_generators", build_generators(src.get("generators"), county))
    excl = keep("exclusions", None if not src.get("exclusions") else polygon_columns(build_exclusions(src["exclusions"], county)))
    slope = None
    if src.get("dem"):
        cells, source_grid, target_grid, to_source = src["dem"]
        raster = keep("slope_cells", build_slope(cells, source_grid, target_grid, county, to_source))
        meta = keep("slope_raster", R.raster_stats(raster, target_grid).withColumn("crs_epsg", F.lit(K.CRS_METRIC_UTM)).withColumn("role", F.lit("screening")))
        checks += [Q.raster_nonzero(meta), Q.crs_check(meta)]
        metric = polygon_columns(parcels.select("id", E.metric_parts(F.col("parts")).alias("parts")))
        slope = R.two_resolution(metric, raster, target_grid, None, None, ["id"], src.get("assign", "last"))
    checks += [Q.nonzero_after_clip(n, tables[n]) for n in ("transmission_lines", "substations", "flood_sfha", "ghi_grid")]
    warnings = Q.enforce(_union(checks))
    enriched = E.enrich_assemble(parcels, subs, line_layer_metric(lines), grid, flood, zoning, comp, excl, gens, slope)
    keep("parcels", layer_frame(spatial_order(enriched)))
    need = [n for n in K.REQUIRED_LAYERS if n != "slope_raster" or src.get("dem")]
    Q.enforce(Q.require_tables(spark, tables, need))
    tables["warnings"] = warnings
    return tables


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out
