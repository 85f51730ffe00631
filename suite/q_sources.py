"""Scans, sources, sinks and column resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from landsieve import constants as K
from landsieve.functions import cleaning as C
from landsieve.functions import geometry as G
from landsieve.operators import economics as EC
from landsieve.operators import ordering as O
from landsieve.operators import quality as Q
from landsieve.operators import raster as R
from landsieve.operators import requests as RQ
from landsieve.operators import results as RS
from landsieve.operators import rules as RU
from landsieve.operators import scoring as SC
from landsieve.operators.spatial import clip_points
from landsieve.session import fresh_path, materialize
from landsieve.sources import readers as S
from landsieve.sources import writers as W
from suite.registry import lng, q, s, scaled
from suite.tables import box_layer, boundary, d, flood_geo, metric, parcels_geo, view

IN_L = "((x >= -119.9 and x <= -118.1 and y >= 34.9 and y <= 35.2) or (x >= -119.9 and x <= -119.0 and y >= 35.2 and y <= 35.6))"
PER_PAGE = 100


def _pages(spark, sf):
    """Feature-collection pages of the substations, PER_PAGE features each."""
    sub = view(spark, sf, "substations")
    feat = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("source_id").alias("ID"), F.col("name").alias("NAME"), F.col("raw_kv").alias("MAX_VOLT")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry"))
    return (
        sub.withColumn("page", F.floor((F.col("id") - 1) / PER_PAGE).cast("int")).groupBy("page")
        .agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feat).alias("features"))).alias("body")))


def _points_out(feats):
    p = S.parse_point(F.col("kind"), F.col("coordinates"))
    return feats.select(F.col("properties")["ID"].alias("source_id"), F.col("properties")["NAME"].alias("name"),
                        F.col("properties")["MAX_VOLT"].alias("volt"), scaled(p["x"], 1e9).alias("x9"), scaled(p["y"], 1e9).alias("y9"))


_SUB_SQL = f"select source_id, name, cast(raw_kv as string) as volt, {s('x', 1e9)} as x9, {s('y', 1e9)} as y9 from substations"


@q("read_features", _SUB_SQL)
def read_features(spark, sf):
    path = fresh_path(spark, "features")
    _pages(spark, sf).select("page", "body").write.partitionBy("page").text(path)  # a file for each collection
    return _points_out(S.read_features(spark, path))


@q("read_feature_pages", _SUB_SQL)
def read_feature_pages(spark, sf):
    pages = materialize(_pages(spark, sf), "pages")
    return _points_out(S.read_feature_pages(pages, PER_PAGE, view(spark, sf, "substations").count()))


@q("source_fallback", f"select id, {s('x', 1e9)} as x9 from substations")
def source_fallback(spark, sf):
    sub = view(spark, sf, "substations")
    _, df = S.source_fallback([("first", sub.filter("x > 0")), ("second", sub)])
    return df.select("id", scaled("x", 1e9).alias("x9"))


@q("predicate_into_scan", "select id from overlays where x0 <= -118.5 and x1 >= -119.5 and y0 <= 35.5 and y1 >= 35.0 and kind = 'open_water'")
def predicate_into_scan(spark, sf):
    path = fresh_path(spark, "overlays")
    W.write_layer(box_layer(view(spark, sf, "overlays")).drop("x0", "y0", "x1", "y1"), path)
    return S.predicate_into_scan(spark.read.parquet(path), (-119.5, 35.0, -118.5, 35.5), F.col("kind") == "open_water").select("id")


@q("read_csv_varchar", "select cast(queue_id as string) as queue_id, capacity_text, county, poi_name, volt_text from queue_raw")
def read_csv_varchar(spark, sf):
    path = fresh_path(spark, "queue-csv")
    view(spark, sf, "queue_raw").write.csv(path, header=True, ignoreLeadingWhiteSpace=False)
    return S.read_csv_text(spark, path).select("queue_id", "capacity_text", "county", "poi_name", "volt_text")


@q("read_csv_inferred", f"select id, {s('lon', 1e6)} as lon6, {s('avg_ghi', 1e6)} as ghi6 from solar")
def read_csv_inferred(spark, sf):
    path = fresh_path(spark, "solar-csv")
    view(spark, sf, "solar").write.csv(path, header=True)
    t = S.read_csv_typed(spark, path)
    return t.select(F.col("id").cast("long").alias("id"), scaled("lon", 1e6).alias("lon6"), scaled("avg_ghi", 1e6).alias("ghi6"))


_LAYER_SQL = f"select id, kind, {s('x0', 1e6)} as xmin6, {s('y0', 1e6)} as ymin6, {s('x1', 1e6)} as xmax6, {s('y1', 1e6)} as ymax6, cast(5 as int) as n from overlays"


def _layer_back(spark, sf):
    path = fresh_path(spark, "layer")
    W.write_layer(view(spark, sf, "overlays").withColumn(
        "parts", G.box_polygon(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))), path)
    return path


def _bbox6():
    return [scaled(f"bbox.{c}", 1e6).alias(f"{c}6") for c in ("xmin", "ymin", "xmax", "ymax")]


@q("read_layer", _LAYER_SQL)
def read_layer(spark, sf):
    df = S.read_layer(spark, _layer_back(spark, sf))
    return df.select("id", "kind", *_bbox6(), G.vertex_count(F.col("parts")).alias("n"))


@q("write_layer", _LAYER_SQL)
def write_layer(spark, sf):
    df = spark.read.parquet(_layer_back(spark, sf))
    return df.select("id", "kind", *_bbox6(), G.vertex_count(F.col("geometry")).alias("n"))


@q("write_plain_table", "select zone_code, zone_name, use_case, permission, basis from rules")
def write_plain_table(spark, sf):
    path = fresh_path(spark, "plain")
    W.write_plain_table(view(spark, sf, "rules"), path)
    return spark.read.parquet(path)


@q("write_features", f"select id, trim(apn) as apn, {s('x0', 1e5)} as x5, {s('y1', 1e5)} as y5 from parcels")
def write_features(spark, sf):
    path = fresh_path(spark, "geojson")
    p = parcels_geo(spark, sf).select("id", "apn", "acres", S.format_polygon(
        G.box_polygon(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), None).alias("g"))
    W.write_features(S.feature_json(p, "g", "id"), path)
    back = S.read_feature_lines(spark, path)
    parts = S.parse_polygon(F.col("kind"), F.col("coordinates"))
    return back.select(F.col("properties")["id"].cast("long").alias("id"), F.trim(F.col("properties")["apn"]).alias("apn"),
                       scaled(G.bbox(parts)["xmin"], 1e5).alias("x5"), scaled(G.bbox(parts)["ymax"], 1e5).alias("y5"))


def _num(c: str, digits: int) -> str:
    """A number as the result file shows it, in SQL text."""
    k = f"cast({float(10**digits)!r} as double)"
    return (f"case when {c} is null then '' else regexp_replace(regexp_replace(cast(cast(floor({c} * {k} + 0.5) / {k} as decimal(38,6)) as string), "
            f"'(\\.\\d*?)0+$', '\\1'), '\\.$', '') end")


_CSV_SQL = f"""
with top as (select *, row_number() over (order by coalesce(acres, 0) desc, id) as rank from parcels),
t as (select *, case when apn like '=%' then concat(chr(39), apn) else apn end as a from top)
select 0 as rank, 'rank,id,apn,score,acres,zoning_class,sfha_flag,ghi,mean_slope_pct,dist_tx_m,dist_sub_m,nearest_sub_kv,poi_competition_mw' as line
union all select rank, concat_ws(',', rank, id, case when a like '%"%' or a like '%,%' then concat('"', replace(a, '"', '""'), '"') else a end,
 {_num('dist_sub_m / cast(250.0 as double)', 2)}, {_num('acres', 2)}, coalesce(zoning_class, ''), coalesce(cast(sfha_flag as string), ''), {_num('ghi', 2)},
 {_num('mean_slope_pct', 2)}, {_num('dist_tx_m', 1)}, {_num('dist_sub_m', 1)}, {_num('nearest_sub_kv', 2)}, {_num('poi_competition_mw', 2)}) from t
"""


@q("write_results_csv", _CSV_SQL)
def write_results_csv(spark, sf):
    """Every parcel ranked and written, the lines read back (the reader takes the byte order mark off): header, all columns."""
    path = fresh_path(spark, "results-csv")
    p = view(spark, sf, "parcels").withColumn("score", F.col("dist_sub_m") / 250.0)
    W.write_ranked_csv(O.ordered_id(p, [F.desc(F.coalesce("acres", F.lit(0.0))), "id"], "rank"), path)
    lines = spark.read.option("lineSep", "\r\n").text(path).withColumnRenamed("value", "line")
    number = F.coalesce(F.regexp_extract("line", r"^(\d+),", 1).try_cast("long"), F.lit(0).cast("long"))
    return lines.select(number.alias("rank"), "line")


@q("overlay_layer", f"select kind, count(*) as n, {lng('sum(id)')} as ids from overlays group by kind")
def overlay_layer(spark, sf):
    o = view(spark, sf, "overlays").withColumn("parts", G.box_polygon(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    layer = o.select("id", "kind", S.format_polygon(F.col("parts")).alias("geometry_json"))
    feats = S.overlay_layer({"exclusions": layer}, "exclusions", {"exclusions": "exclusions"})
    get = lambda p: F.get_json_object("feature", p)
    return feats.filter(get("$.geometry.type") == "Polygon").groupBy(get("$.properties.kind").alias("kind")).agg(
        F.count("*").alias("n"), F.sum(get("$.properties.id").cast("long")).alias("ids"))


@q("solar_response_parse", f"""
select id, case when id % 5 = 1 then null else {s('avg_ghi', 1e6)} end as ghi6, case when id % 4 = 0 then 5 else null end as dni
from solar where id % 7 <> 3 and not (id % 5 = 1 and id % 4 <> 0)""")
def solar_response_parse(spark, sf):
    g = view(spark, sf, "solar")
    body = F.when(F.col("id") % 7 == 3, F.lit('{"outputs": {"avg_ghi"')).otherwise(F.concat(
        F.lit('{"outputs":{"avg_ghi":'), F.when(F.col("id") % 5 == 1, F.lit('"no data"')).otherwise(
            F.concat(F.lit('{"annual":'), F.col("avg_ghi").cast("string"), F.lit("}"))),
        F.lit(',"avg_dni":'), F.when(F.col("id") % 4 == 0, F.lit('{"annual":5}')).otherwise(F.lit("null")), F.lit("}}")))
    r = g.withColumn("body", body).withColumn("lon", F.col("id"))
    return S.solar_response_parse(r).select(F.col("lon").alias("id"), scaled("avg_ghi", 1e6).alias("ghi6"), F.col("avg_dni").cast("int").alias("dni"))


_MED_SQL = """
select county, v as median_home_value_usd, concat(cast(yr as string), ' ACS 5-year') as acs_vintage from (
  select county, yr, cast(value_text as bigint) as v, row_number() over (partition by county order by yr desc, cast(value_text as bigint) desc) as rn
  from medians where value_text <> 'null') m where rn = 1 and v > -100000000
"""


def _medians(spark, sf):
    body = F.when(F.col("k") % 11 == 0, F.lit('[["B25077_001E","NAME"]]')).otherwise(
        F.concat(F.lit('[["B25077_001E","NAME"],["'), F.col("value_text"), F.lit('","x"]]')))
    return view(spark, sf, "medians").select("county", F.col("yr").alias("year"), body.alias("body"))


@q("median_value_parse", _MED_SQL.replace("value_text <> 'null'", "value_text <> 'null' and k % 11 <> 0"))
def median_value_parse(spark, sf):
    return EC.median_value_parse(_medians(spark, sf))


def price_bodies(spark, sf):
    p = view(spark, sf, "prices")
    obs = F.struct(F.col("obs_date").alias("date"), F.col("value_text").alias("value"))
    # At most 500 observations per answer text.
    return p.groupBy("county", F.floor(F.col("k") / 500).alias("chunk")).agg(
        F.to_json(F.struct(F.collect_list(obs).alias("observations"))).alias("body"))


@q("price_series_parse", "select county, obs_date as \"date\", cast(value_text as double) as value from prices where value_text not in ('.', '')")
def price_series_parse(spark, sf):
    return EC.price_series_parse(price_bodies(spark, sf))


@q("rules_csv_read", "select zone_code, zone_name, use_case, permission, basis from rules")
def rules_csv_read(spark, sf):
    path = fresh_path(spark, "rules")
    view(spark, sf, "rules").write.csv(path, header=True)
    return S.read_csv_text(spark, path)


@q("rules_csv_write", "select zone_code, zone_name, use_case, permission, basis from rules")
def rules_csv_write(spark, sf):
    path = fresh_path(spark, "rules")
    W.write_rules(view(spark, sf, "rules").select("basis", "permission", "use_case", "zone_name", "zone_code"), path)
    return spark.read.csv(path, header=True).select(*RU.COLUMNS)


@q("rules_lenient_read", "select trim(zone_code) as zone_code, use_case, permission, count(*) as n from rules_raw where trim(zone_code) <> '' and permission <> '' group by 1, 2, 3")
def rules_lenient_read(spark, sf):
    return RU.rules_lenient(view(spark, sf, "rules_raw")).groupBy("zone_code", "use_case", "permission").agg(F.count("*").alias("n"))


@q("optional_layer", "select 'configured' as source, count(*) as n from generators union all select 'missing', 0")
def optional_layer(spark, sf):
    schema = "id long, x double, y double"
    there = S.optional_layer(spark, view(spark, sf, "generators"), schema).agg(F.count("*").alias("n")).select(F.lit("configured").alias("source"), "n")
    gone = S.optional_layer(spark, None, schema).agg(F.count("*").alias("n")).select(F.lit("missing").alias("source"), "n")
    return there.unionByName(gone)


def _entry(pos: int, key: str, count: str) -> str:
    return (f"select {pos} as pos, '{key}' as key, n as features, 'derived' as source, concat('{{\"features\":', cast(n as string), ',\"source\":\"derived\"}}') as value "
            f"from (select count(*) as n from {count}) t{pos}")


@q("manifest", f"""{_entry(0, 'parcels', 'orders')} union all {_entry(1, 'substations', 'supplier')} union all {_entry(2, 'zoning', 'zones')}
 union all select 3, 'crs', null, null, '"EPSG:4326"'""")
def manifest(spark, sf):
    return W.manifest({n: (view(spark, sf, v), "derived") for n, v in (("parcels", "parcels"), ("substations", "substations"), ("zoning", "zones"))},
                      {"crs": '"EPSG:4326"'})


@q("publish_release", "select 'parcels' as tbl, count(*) as n from orders union all select 'substations', count(*) from supplier")
def publish_release(spark, sf):
    root = fresh_path(spark, "published")
    tables = {"parcels": view(spark, sf, "parcels"), "substations": view(spark, sf, "substations")}
    W.publish_release(spark, root, "r1", tables)
    base = W.current_release(spark, root)
    count = lambda n: spark.read.parquet(f"{base}/{n}").agg(F.count("*").alias("n")).select(F.lit(n).alias("tbl"), "n")
    return count("parcels").unionByName(count("substations"))


# --- 2.2 column resolution, filters ---------------------------------------------

@q("pick_column", "select id, name from substations")
def pick_column(spark, sf):
    df = view(spark, sf, "substations").withColumnRenamed("name", "Sub_Name")
    return df.select("id", F.col(C.pick_column(df.columns, K.FIELDS["sub_name"], "name")).alias("name"))


@q("text_or_null", "select id, cast(raw_kv as string) as volt, cast(null as string) as owner from substations")
def text_or_null(spark, sf):
    df = view(spark, sf, "substations")
    return df.select("id", C.text_or_null("raw_kv").alias("volt"), C.pick_text(df, "line_owner").alias("owner"))


@q("forced_column", "select id, source_id as apn from substations")
def forced_column(spark, sf):
    df = view(spark, sf, "substations").withColumn("APN", F.lit("x"))
    return df.select("id", C.pick_text(df, "apn", forced="SOURCE_ID").alias("apn"))


@q("drop_empty_geom", "select id from overlays where id % 4 not in (1, 2)")
def drop_empty_geom(spark, sf):
    from landsieve.plans.build import drop_empty_geom as keep
    o = view(spark, sf, "overlays")
    box = G.box_polygon(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    parts = F.when(F.col("id") % 4 == 1, F.lit(None).cast(G.PARTS_T)).when(F.col("id") % 4 == 2, F.array().cast(G.PARTS_T)).otherwise(box)
    return o.withColumn("parts", parts).filter(keep()).select("id")


@q("county_filter", "select '06029' as geoid, count(*) as parcels from orders")
def county_filter(spark, sf):
    """One boundary row from a county table derived from the customers' keys."""
    from landsieve.plans.build import build_county
    c = view(spark, sf, "overlays").select(
        F.map_from_arrays(F.array(*[F.lit(x) for x in ("GEOID", "STATEFP", "COUNTYFP", "NAME")]), F.array(
            F.when(F.col("id") == 29, F.lit("06029")).otherwise(F.concat(F.lit("07"), F.lpad(F.col("id").cast("string"), 6, "0"))),
            F.when(F.col("id") == 29, F.lit("06")).otherwise(F.lit("07")), F.lpad(F.col("id").cast("string"), 3, "0"), F.col("kind"))).alias("properties"),
        F.lit("Polygon").alias("kind"), F.to_json(F.array(F.transform(
            G.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), lambda p: F.array(p["x"], p["y"])))).alias("coordinates"),
        F.lit("f").alias("source_file"), F.col("id").alias("pos"))
    county = build_county(c)
    return spark.read.parquet(f"{sf}/orders.parquet").agg(F.count("*").alias("parcels")).withColumn(
        "geoid", county.select("geoid").scalar()).select("geoid", "parcels")


@q("flood_zone_filter", "select id from floods where (upper(trim(fld_zone)) like 'A%' or upper(trim(fld_zone)) like 'V%') and upper(trim(fld_zone)) <> 'AREA NOT INCLUDED' and (sfha_tf is null or upper(trim(sfha_tf)) <> 'F')")
def flood_zone_filter(spark, sf):
    return view(spark, sf, "floods").filter(C.is_flood_hazard(F.col("fld_zone"), F.col("sfha_tf"))).select("id")


@q("county_word_filter", "select queue_id from queue_raw where county in ('Kern', ' kern county', 'Los Angeles, Kern')")
def county_word_filter(spark, sf):
    return view(spark, sf, "queue_raw").filter(C.mentions_county(F.col("county"))).select("queue_id")


@q("active_status", "select queue_id, status is not null and status not in ('Withdrawn', 'Completed', 'IN SERVICE since') as is_active from queue_raw")
def active_status(spark, sf):
    return view(spark, sf, "queue_raw").select("queue_id", C.is_active(F.col("status")).alias("is_active"))


@q("coord_filter", "select id from solar where id % 3 <> 0 and id % 5 <> 0")
def coord_filter(spark, sf):
    g = view(spark, sf, "solar").withColumn("lon", F.when(F.col("id") % 3 != 0, F.col("lon"))).withColumn(
        "avg_ghi", F.when(F.col("id") % 5 != 0, F.col("avg_ghi")))
    return Q.with_coordinates(g, ["lon", "lat", "avg_ghi"]).select("id")


FLAGS = """coalesce(acres < 20, false) as excl_min_acres, coalesce(sfha_flag, false) as excl_sfha,
coalesce(mean_slope_pct > 15, false) as excl_slope, coalesce(zoning_class in ('E', 'R-1'), false) as excl_zoning,
(coalesce(excl_protected_area, false) or coalesce(excl_open_water, false) or coalesce(excl_built_up, false)) as excl_optional"""
TH = {"apply_optional_exclusions": True}


@q("exclusion_flags", f"select id, {FLAGS} from parcels")
def exclusion_flags(spark, sf):
    th = SC.resolve_thresholds("utility_solar", TH)
    return SC.exclusion_flags(view(spark, sf, "parcels"), th, ["E", "R-1"]).select("id", *SC.EXCLUSIONS)


@q("excluded_filter", f"select id from (select id, {FLAGS} from parcels) f where not (excl_min_acres or excl_sfha or excl_slope or excl_zoning or excl_optional)")
def excluded_filter(spark, sf):
    th = SC.resolve_thresholds("utility_solar", TH)
    return SC.exclusion_flags(view(spark, sf, "parcels"), th, ["E", "R-1"]).filter(~SC.any_exclusion()).select("id")


@q("parcel_lookup", f"""select w.event_id, w.want as id, {s('p.x', 1e9)} as x9, case when p.id is null then 'parcel not found' end as error
 from (select event_id, event_id * 3 + 1 as want from events) w left join parcels p on p.id = w.want""")
def parcel_lookup(spark, sf):
    """Many lookups at once; an unknown id comes back with its error."""
    want = spark.read.parquet(f"{sf}/events.parquet").select("event_id", (F.col("event_id") * 3 + 1).alias("id"))
    found = RS.parcel_lookup(view(spark, sf, "parcels").select("id", "x"), want)
    return found.select("event_id", "id", scaled("x", 1e9).alias("x9"), "error")


_BAD = """case when request_id % 11 = 3 then 'geometry type' when request_id % 11 = 4 then 'no coordinates' when request_id % 11 = 5 then 'too many vertices'
when request_id % 11 = 6 then 'unknown weight' when request_id % 11 = 7 then 'bad weight' when request_id % 11 = 8 then 'limit' when request_id % 11 = 9 then 'offset' else null end"""


@q("request_validate", f"select request_id, {_BAD} as reject_reason from requests")
def request_validate(spark, sf):
    k = F.col("request_id") % 11
    r = view(spark, sf, "requests").select(
        "request_id", F.when(k == 3, "Point").when(k == 2, "MultiPolygon").otherwise("Polygon").alias("geometry_type"),
        F.when(k == 4, 0).when(k == 5, 50001).otherwise(5).alias("vertices"),
        F.when(k == 6, F.create_map(F.lit("nope"), F.lit(1.0))).when(k == 7, F.create_map(F.lit("ghi"), F.lit(-1.0)))
        .when(k == 1, F.create_map(F.lit("ghi"), F.lit(0.3))).alias("weights"),
        F.when(k == 8, 1001).otherwise(F.col("limit")).alias("limit"), F.when(k == 9, -1).otherwise(F.col("offset")).alias("offset"))
    return RQ.request_validate(r).select("request_id", "reject_reason")


@q("zone_code_validate", """
select p_partkey, case when p_partkey % 3 = 0 then 'A,M-1' when p_partkey % 3 = 1 then concat(';x,A/', cast(p_partkey as string)) else '' end as codes,
  case when p_partkey % 3 = 1 then 1 else 0 end as bad from part""")
def zone_code_validate(spark, sf):
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.array(F.lit(" M-1"), F.lit("A"), F.lit("A "))).when(
        k % 3 == 1, F.array(F.lit(";x"), F.concat(F.lit("A/"), k.cast("string")))).otherwise(F.array(F.lit(" "), F.lit(None).cast("string")))
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", raw.alias("raw"))
    return p.select("p_partkey", F.array_join(RQ.zone_codes_clean(F.col("raw")), ",").alias("codes"), F.size(RQ.zone_codes_bad(F.col("raw"))).alias("bad"))


_SPH = "6371008.8 * 6371008.8 * radians(x1 - x0) * abs(sin(radians(y1)) - sin(radians(y0)))"


@q("area_guard", f"select request_id, {s(_SPH + ' / 10000.0', 1)} as hectares, 9 * ({_SPH}) > 5000000000.0 as too_large from requests")
def area_guard(spark, sf):
    """The trapezoid rule along parallels is exact for boxes."""
    r = view(spark, sf, "requests").withColumn("parts", G.box_polygon(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    return RQ.area_guard(r, max_sqm=K.MAX_AREA_SQM / 9).select("request_id", scaled(F.col("area_sqm") / 10000.0, 1).alias("hectares"), "too_large")


@q("result_filters", "select id from parcels where coalesce(acres, 0) >= 50 and (mean_slope_pct is null or mean_slope_pct <= 10) and (dist_tx_m is null or dist_tx_m / 1000 <= 12)")
def result_filters(spark, sf):
    return RS.result_filters(view(spark, sf, "parcels"), 50, 10, 12).select("id")


@q("result_projection", f"""select id, apn, 1 as rank, cast(1.0 as double) as score, acres, zoning_class, sfha_flag, {s('x', 1e6)} as lng6, {s('y', 1e6)} as lat6,
 {', '.join(RS.FACTOR_PROPS)} from parcels""")
def result_projection(spark, sf):
    p = view(spark, sf, "parcels").withColumn("rank", F.lit(1)).withColumn("score", F.lit(1.0)).withColumn(
        "centroid_lng", F.col("x")).withColumn("centroid_lat", F.col("y"))
    r = RS.result_projection(p)
    return r.select("id", "apn", "rank", "score", "acres", "zoning_class", "sfha_flag", scaled(F.col("centroid")[0], 1e6).alias("lng6"),
                    scaled(F.col("centroid")[1], 1e6).alias("lat6"), "factors.*")


@q("raw_struct", f"select {', '.join(K.RAW_COLUMNS)} from parcels")
def raw_struct(spark, sf):
    return view(spark, sf, "parcels").select(RS.raw_struct().alias("raw")).select("raw.*")


@q("dominant_reasons", """
select id, array_to_string(list_filter([
  case when ghi >= 6 then 'Strong sun' end, case when dist_tx_m <= 3000 then 'Near transmission' end,
  case when nearest_sub_kv >= 200 then 'High-voltage substation' end, case when acres >= 100 then 'Large site' end,
  case when mean_slope_pct <= 3 then 'Flat terrain' end], lambda t: t is not null)[1:2], '|') as tags from parcels""")
def dominant_reasons(spark, sf):
    return view(spark, sf, "parcels").select("id", F.array_join(SC.dominant_reasons(), "|").alias("tags"))


# --- 2.11 checks ----------------------------------------------------------------

@q("require_tables", """
select 'exists:parcels' as "check", true as ok, 'present' as detail union all select 'exists:substations', true, 'present' union all select 'exists:zoning', true, 'present'
union all select 'exists:slope_raster', false, 'missing'
union all select 'not_empty:parcels', true, concat(cast(count(*) as string), ' rows') from orders
union all select 'not_empty:substations', count(*) > 0, concat(cast(count(*) as string), ' rows') from supplier
union all select 'not_empty:zoning', false, '0 rows'""")
def require_tables(spark, sf):
    layers = {"parcels": view(spark, sf, "parcels"), "substations": view(spark, sf, "substations"), "zoning": view(spark, sf, "zones").filter("id < 0")}
    return Q.require_tables(spark, layers, ["parcels", "substations", "zoning", "slope_raster"]).select("check", "ok", "detail")


@q("nonzero_after_clip", f"select 'nonzero_after_clip:substations' as \"check\", count(*) > 0 as ok, concat(cast(count(*) as string), ' rows') as detail from substations where {IN_L}")
def nonzero_after_clip(spark, sf):
    inside = clip_points(view(spark, sf, "substations"), boundary(spark), 0.25, "x", "y", "id")
    return Q.nonzero_after_clip("substations", inside).select("check", "ok", "detail")


@q("raster_nonzero", "select 'raster_nonzero' as \"check\", count(z) > 0 as ok, concat(cast(count(z) as string), ' valid cells') as detail from dem")
def raster_nonzero(spark, sf):
    cells = view(spark, sf, "dem").select(F.col("row_").alias("row"), F.col("col_").alias("col"), F.col("z").alias("value"))
    return Q.raster_nonzero(R.raster_stats(cells, R.Grid(0, 0, 30, 30, 10, 150))).select("check", "ok", "detail")


@q("rules_validate", """
select line, zone_code, use_case, permission, problem from (
  select line, trim(zone_code) as zone_code, use_case, permission,
    case when trim(zone_code) = '' then 'empty zone_code or use_case' when permission not in ('by_right', 'conditional', 'prohibited') then 'unknown permission'
      when use_case = 'mining' then 'unknown use case' when line > min(line) over (partition by trim(zone_code), use_case) then 'duplicate rule' end as problem
  from rules_raw) r where problem is not null""")
def rules_validate(spark, sf):
    return RU.rules_validate(view(spark, sf, "rules_raw"))


@q("schema_check", "select 'schema:overlays' as \"check\", true as ok, count(*) as rows_ from overlays")
def schema_check(spark, sf):
    layer = spark.read.parquet(_layer_back(spark, sf))
    n = layer.agg(F.count("*")).scalar()
    return Q.schema_check(spark, "overlays", layer).select("check", "ok", n.alias("rows_"))


@q("crs_check", "select 'crs:screening' as \"check\", true as ok, 'EPSG:26911' as detail, count(*) as n from orders")
def crs_check(spark, sf):
    meta = view(spark, sf, "dem").agg(F.count("*").alias("n")).withColumn("role", F.lit("screening")).withColumn("crs_epsg", F.lit(26911))
    return Q.crs_check(meta).withColumn("n", meta.select("n").scalar()).select("check", "ok", "detail", "n")
