"""Spatial joins, geometry, rasters, tiles and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from landsieve import constants as K
from landsieve.functions import geometry as G
from landsieve.functions import projection as P
from landsieve.operators import box_totals as BT
from landsieve.operators import enrich as E
from landsieve.operators import ordering as O
from landsieve.operators import queue as QU
from landsieve.operators import raster as R
from landsieve.operators import repair as RP
from landsieve.operators import scoring as SC
from landsieve.operators import spatial as S
from landsieve.operators import tiles as T
from landsieve.operators import union as UN
from landsieve.operators import usage as U
from landsieve.plans.build import exclusions_union
from landsieve.session import fresh_path, materialize
from landsieve.sources import readers as RD
from landsieve.streaming import usage as ST
from suite.q_scoring import ACTIVE, COST, MW, norm_name_sql, queue, usage_rows, with_usage_json
from suite.q_sources import IN_L
from suite.registry import lng, q, s, scaled
from suite.tables import (L_SHAPE, box_layer, boundary, d, flood_geo, line_geo, metric, parcel_points, parcels_geo, utm_sql, view)

UX, UY = utm_sql("x", "y")
PM = f"select id, {UX} as mx, {UY} as my from parcels"
SM = f"select id, max_voltage_kv, {UX} as mx, {UY} as my from substations"
DIST = "sqrt((p.mx - t.mx) * (p.mx - t.mx) + (p.my - t.my) * (p.my - t.my))"
CM = 100.0


def subs_m(spark, sf):
    return metric(view(spark, sf, "substations"))


# --- clipping -------------------------------------------------------------------

@q("clip_points", f"select id from substations where {IN_L}")
def clip_points(spark, sf):
    return S.clip_points(view(spark, sf, "substations"), boundary(spark), 0.25, "x", "y", "id").select("id")


def _box_parts(x0, y0, x1, y1):
    """Area of a box inside the L-shaped boundary, in SQL text."""
    def one(a, b, c, e):
        return (f"greatest(least({x1}, {d(c)}) - greatest({x0}, {d(a)}), 0.0) * greatest(least({y1}, {d(e)}) - greatest({y0}, {d(b)}), 0.0)")

    return f"({one(-119.9, 34.9, -118.1, 35.2)} + {one(-119.9, 35.2, -119.0, 35.6)})"


_CLIP = _box_parts("x0", "y0", "x1", "y1")


@q("clip_polygons", f"select id, kind, {s(_CLIP, 1e9)} as area9 from overlays where {_CLIP} > 0")
def clip_polygons(spark, sf):
    cut = S.clip_polygons(box_layer(view(spark, sf, "overlays")).select("id", "kind", "parts"), boundary(spark), 0.25, "id")
    return cut.select("id", "kind", scaled(G.area(F.col("parts")), 1e9).alias("area9"))


_SEG = """select line_id, 1 as seq, ax as x1, ay as y1, bx as x2, by_ as y2 from lines union all select line_id, 2, bx, by_, cx, cy from lines"""


def _seg_len(a, b, c, e):
    """Clipped length of a segment inside one box, by parameter interval."""
    def lo(p, q_, mn, mx):
        return f"case when {q_} = {p} then (case when {p} >= {mn} and {p} <= {mx} then 0.0 else 2.0 end) else least(({mn} - {p}) / ({q_} - {p}), ({mx} - {p}) / ({q_} - {p})) end"

    def hi(p, q_, mn, mx):
        return f"case when {q_} = {p} then 1.0 else greatest(({mn} - {p}) / ({q_} - {p}), ({mx} - {p}) / ({q_} - {p})) end"

    t0 = f"greatest(0.0, {lo('x1', 'x2', d(a), d(c))}, {lo('y1', 'y2', d(b), d(e))})"
    t1 = f"least(1.0, {hi('x1', 'x2', d(a), d(c))}, {hi('y1', 'y2', d(b), d(e))})"
    return f"greatest({t1} - {t0}, 0.0) * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))"


_LEN = f"({_seg_len(-119.9, 34.9, -118.1, 35.2)} + {_seg_len(-119.9, 35.2, -119.0, 35.6)})"


@q("clip_lines", f"select line_id, {s('sum(len)', 1e7)} as length7 from (select line_id, {_LEN} as len from ({_SEG}) g) c group by 1 having sum(len) > 0")
def clip_lines(spark, sf):
    cut = S.clip_lines(line_geo(view(spark, sf, "lines"), metres=False).select("line_id", "line"), boundary(spark), 0.25, "line_id", "line")
    length = F.aggregate(F.flatten(F.transform("pieces", G.ring_edges)), F.lit(0.0),
                         lambda a, e: a + G.distance(e["x1"], e["y1"], e["x2"], e["y2"]))
    return cut.select("line_id", scaled(length, 1e7).alias("length7"))


# --- nearest --------------------------------------------------------------------

def _nearest(sql_t, cols):
    return (f"select p.id, {cols} from (select p.id, t.*, {DIST} as dist, row_number() over (partition by p.id order by {DIST}, t.tid) as rn "
            f"from ({PM}) p, ({sql_t}) t) p where rn = 1")


_SUB_T = f"select id as tid, max_voltage_kv as kv, {UX} as mx, {UY} as my from substations"


@q("nearest_substation", f"select p.id, p.tid as sub_id, p.kv as nearest_sub_kv, {s('p.dist', CM)} as dist_cm from (select p.id, t.tid, t.kv, {DIST} as dist, row_number() over (partition by p.id order by {DIST}, t.tid) as rn from ({PM}) p, ({_SUB_T}) t) p where rn = 1")
def nearest_substation(spark, sf):
    n = E.nearest_substation(parcel_points(spark, sf), subs_m(spark, sf))
    return n.select("id", "sub_id", "nearest_sub_kv", scaled("dist_sub_m", CM).alias("dist_cm"))


@q("arg_min_struct", f"select p.id, min(struct_pack(dd := {s(DIST, 1.0)}, i := t.tid)).i as sub_id from ({PM}) p, ({_SUB_T.replace('max_voltage_kv as kv, ', '')}) t group by p.id".replace("min(struct_pack", "min(struct_pack"))
def arg_min_struct(spark, sf):
    """Deterministic nearest with distance in whole metres, ties by station id.

    Rounding makes real ties, so all stations within the rounding step of the
    nearest are compared again through the radius of that step.
    """
    pts = parcel_points(spark, sf)
    sub = subs_m(spark, sf).select(F.col("id").alias("sub_id"), "mx", "my")
    n = S.nearest_join(pts, sub.select("sub_id", F.col("mx").alias("rx"), F.col("my").alias("ry"), F.lit(1.0).alias("reach")), "id", "mx", "my",
                       lambda x, y, i: F.floor(G.distance(x, y, i["rx"], i["ry"]) + 0.5).cast("double"), "sub_id", [], "reach")
    return n.select("id", "sub_id")


_SOL_T = f"select id as tid, avg_ghi, {utm_sql('lon', 'lat')[0]} as mx, {utm_sql('lon', 'lat')[1]} as my from solar"


def _ghi_sql():
    return f"select p.id, {s('p.avg_ghi', 1e6)} as ghi6 from (select p.id, t.avg_ghi, row_number() over (partition by p.id order by {DIST}, t.tid) as rn from ({PM}) p, ({_SOL_T}) t) p where rn = 1"


def ghi_grid(spark, sf):
    return metric(view(spark, sf, "solar"), "lon", "lat")


@q("nearest_ghi", _ghi_sql())
def nearest_ghi(spark, sf):
    return E.nearest_ghi(parcel_points(spark, sf), ghi_grid(spark, sf)).select("id", scaled("ghi", 1e6).alias("ghi6"))


@q("arg_min_scalar", f"select x.sub_id, {s('x.avg_ghi', 1e6)} as ghi6 from (select p.id as sub_id, t.avg_ghi, row_number() over (partition by p.id order by {DIST}, t.tid) as rn from ({SM}) p, ({_SOL_T}) t) x where rn = 1")
def arg_min_scalar(spark, sf):
    """One value of the nearest solar point, per substation."""
    n = E.nearest_ghi(subs_m(spark, sf).select("id", "mx", "my"), ghi_grid(spark, sf))
    return n.select(F.col("id").alias("sub_id"), scaled("ghi", 1e6).alias("ghi6"))


_GEN_T = f"select id as tid, {UX} as mx, {UY} as my from generators"


@q("nearest_generator", f"select p.id, {s(f'min({DIST})', CM)} as dist_cm from ({PM}) p, ({_GEN_T}) t group by p.id")
def nearest_generator(spark, sf):
    n = E.nearest_generator(parcel_points(spark, sf), metric(view(spark, sf, "generators")))
    return n.select("id", scaled("eia_nearest_m", CM).alias("dist_cm"))


@q("min_distance", f"select p.id, {s(f'min({DIST})', CM)} as dist_cm from ({SM}) p, ({_GEN_T}) t group by p.id")
def min_distance(spark, sf):
    n = E.nearest_generator(subs_m(spark, sf).select("id", "mx", "my"), metric(view(spark, sf, "generators")))
    return n.select("id", scaled("eia_nearest_m", CM).alias("dist_cm"))


def _seg_m():
    (ax, ay), (bx, by), (cx, cy) = utm_sql("ax", "ay"), utm_sql("bx", "by_"), utm_sql("cx", "cy")
    pts = f"select line_id, {ax} as pax, {ay} as pay, {bx} as pbx, {by} as pby, {cx} as pcx, {cy} as pcy from lines"
    return f"select line_id, pax as x1, pay as y1, pbx as x2, pby as y2 from ({pts}) a union all select line_id, pbx, pby, pcx, pcy from ({pts}) a"


_T = "least(greatest(((p.mx - g.x1) * (g.x2 - g.x1) + (p.my - g.y1) * (g.y2 - g.y1)) / ((g.x2 - g.x1) * (g.x2 - g.x1) + (g.y2 - g.y1) * (g.y2 - g.y1)), 0.0), 1.0)"
_SD = f"sqrt(pow(p.mx - (g.x1 + {_T} * (g.x2 - g.x1)), 2) + pow(p.my - (g.y1 + {_T} * (g.y2 - g.y1)), 2))"
_TX = f"select p.id, {s(f'min({_SD})', CM)} as dist_cm from ({PM}) p, ({_seg_m()}) g group by p.id"


@q("nearest_line_distance", _TX)
def nearest_line_distance(spark, sf):
    n = E.nearest_line_distance(parcel_points(spark, sf), line_geo(view(spark, sf, "lines")))
    return n.select("id", scaled("dist_tx_m", CM).alias("dist_cm"))


@q("distance_line", f"select p.id, l.line_id, {s(f'min({_SD})', CM)} as dist_cm from ({SM}) p join ({_seg_m()}) g on g.line_id = p.id join lines l on l.line_id = p.id group by 1, 2")
def distance_line(spark, sf):
    """Distance from each substation to the line of the same number."""
    j = subs_m(spark, sf).join(line_geo(view(spark, sf, "lines")), F.col("id") == F.col("line_id"))
    return j.select("id", "line_id", scaled(G.line_distance(F.col("mx"), F.col("my"), F.col("line")), CM).alias("dist_cm"))


@q("distance_points", f"select p.id, {s(DIST, CM)} as dist_cm from ({PM}) p join ({_GEN_T}) t on t.tid = 1 + (p.id * 7) % (select count(*) from supplier)")
def distance_points(spark, sf):
    g = metric(view(spark, sf, "generators")).select(F.col("id").alias("g"), F.col("mx").alias("gx"), F.col("my").alias("gy"))
    n = spark.read.parquet(f"{sf}/supplier.parquet").agg(F.count("*")).scalar()
    p = parcel_points(spark, sf).withColumn("g", 1 + (F.col("id") * 7) % n)
    return p.join(g, "g").select("id", scaled(G.distance(F.col("mx"), F.col("my"), F.col("gx"), F.col("gy")), CM).alias("dist_cm"))


# --- names, competition ----------------------------------------------------------

PN = f"select queue_id, is_active, mw, volt_text, coalesce({norm_name_sql('poi_name')}, '') as pn from (select queue_id, {ACTIVE} as is_active, {MW} as mw, poi_name, volt_text from queue_raw where county in ('Kern', ' kern county', 'Los Angeles, Kern')) q"
SN = f"select id, max_voltage_kv, x, y, {norm_name_sql('name')} as sn from substations"
CAND = f"""select queue_id, id, max_voltage_kv, length(sn) as len, case when pn = sn then 3 when length(sn) >= 4 and (' ' || pn || ' ') like ('% ' || sn || ' %') then 2
 when length(pn) >= 4 and (' ' || sn || ' ') like ('% ' || pn || ' %') then 1 else 0 end as rank from ({PN}) p, ({SN}) s where pn <> '' and sn <> ''"""


@q("poi_name_match", f"select queue_id, id as substation_id, rank from ({CAND}) c where rank > 0")
def poi_name_match(spark, sf):
    return QU.name_candidates(queue(spark, sf), view(spark, sf, "substations"))


@q("best_rank", f"select queue_id, max(rank) as rank, count(*) filter (where rank = top) as n from (select *, max(rank) over (partition by queue_id) as top from ({CAND}) c where rank > 0) b group by 1")
def best_rank(spark, sf):
    """Best rank per project and how many stations share it."""
    return QU.best_rank(queue(spark, sf), view(spark, sf, "substations"))


BEST = f"""select queue_id, id as matched_substation_id, max_voltage_kv, n > 1 as poi_match_ambiguous from (select *, count(*) over (partition by queue_id) as n, row_number() over (partition by queue_id order by len desc, max_voltage_kv desc nulls last, id) as rn
 from (select *, max(rank) over (partition by queue_id) as top from ({CAND}) c where rank > 0) b where rank = top) t where rn = 1"""
MATCHED = f"""select p.queue_id, p.is_active, p.mw, b.matched_substation_id, coalesce(b.poi_match_ambiguous, false) as poi_match_ambiguous,
 coalesce(case when p.volt_text = '230 kV' then 230 end, b.max_voltage_kv) as poi_voltage_kv from ({PN}) p left join ({BEST}) b on b.queue_id = p.queue_id"""


def matched(spark, sf):
    return QU.match_queue(queue(spark, sf), view(spark, sf, "substations"))


@q("best_match", f"select queue_id, matched_substation_id from ({BEST}) b")
def best_match(spark, sf):
    return matched(spark, sf).filter("matched_substation_id is not null").select("queue_id", "matched_substation_id")


@q("match_ambiguous", f"select queue_id, poi_match_ambiguous from ({MATCHED}) m")
def match_ambiguous(spark, sf):
    return matched(spark, sf).select("queue_id", "poi_match_ambiguous")


@q("poi_match_left", f"select queue_id, matched_substation_id, poi_voltage_kv, s.x is not null as placed from ({MATCHED}) m left join substations s on s.id = m.matched_substation_id")
def poi_match_left(spark, sf):
    return matched(spark, sf).select("queue_id", "matched_substation_id", "poi_voltage_kv", F.col("poi_x").isNotNull().alias("placed"))


ACT = f"select matched_substation_id as sid, mw from ({MATCHED}) m where is_active and matched_substation_id is not null"


@q("poi_semi", f"select id, name from substations where id in (select sid from ({ACT}) a)")
def poi_semi(spark, sf):
    return QU.poi_stations(matched(spark, sf), view(spark, sf, "substations")).select("id", "name")


@q("competition_at_poi", f"select sid as substation_id, count(*) as n_at_poi, coalesce(sum(mw), 0) as mw_at_poi from ({ACT}) a group by 1")
def competition_at_poi(spark, sf):
    return QU.competition_at_poi(matched(spark, sf))


NEAR = f"select p.id, count(a.mw) as n_with_mw, count(a.sid) as n_within, coalesce(sum(a.mw), 0) as sum_within from ({SM}) p left join (select sid, mw, mx, my from ({ACT}) a join ({SM}) s on s.id = a.sid) a on sqrt((p.mx - a.mx) * (p.mx - a.mx) + (p.my - a.my) * (p.my - a.my)) <= 10000 group by 1"
COMP = f"select n.id as substation_id, count(a.sid) as n_at_poi, coalesce(sum(a.mw), 0) as mw_at_poi, max(n.n_within) as n_within_radius, max(n.sum_within) as mw_within_radius from ({NEAR}) n join ({ACT}) a on a.sid = n.id group by 1"


@q("radius_join", f"select id, n_within, sum_within from ({NEAR}) n")
def radius_join(spark, sf):
    """Every station, with the active projects within 10 km (zeros for none)."""
    sub = subs_m(spark, sf)
    items = QU.active_matched(matched(spark, sf)).join(
        sub.select(F.col("id").alias("matched_substation_id"), F.col("mx").alias("ix"), F.col("my").alias("iy")), "matched_substation_id").select(
        "ix", "iy", F.coalesce("capacity_mw", F.lit(0.0)).alias("mw"))
    return S.radius_totals(sub.select("id", F.col("mx").alias("cx"), F.col("my").alias("cy")), items, 10_000.0, "id", "mw")


@q("radius_totals", f"select p.id, count(t.tid) as n_within, {lng('coalesce(sum(t.tid), 0)')} as id_sum from ({PM}) p left join ({_SOL_T.replace('avg_ghi, ', '')}) t on {DIST} <= 5000 group by 1")
def radius_totals(spark, sf):
    """Solar points within 5 km of every parcel."""
    c = parcel_points(spark, sf).select("id", F.col("mx").alias("cx"), F.col("my").alias("cy"))
    items = ghi_grid(spark, sf).select(F.col("mx").alias("ix"), F.col("my").alias("iy"), F.col("id").cast("double").alias("v"))
    return S.radius_totals(c, items, 5_000.0, "id", "v").select("id", "n_within", F.col("sum_within").cast("long").alias("id_sum"))


@q("poi_assemble", COMP)
def poi_assemble(spark, sf):
    m = materialize(matched(spark, sf), "matched")
    return QU.poi_competition(m, subs_m(spark, sf)).select("substation_id", "n_at_poi", "mw_at_poi", "n_within_radius", "mw_within_radius")


@q("poi_collapse", "select 1 + o_custkey % 50 as substation_id, max(cast(floor(o_totalprice) as double)) as mw_within_radius, max(o_orderkey % 100) as n_within_radius from orders group by 1")
def poi_collapse(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(
        (1 + F.col("o_custkey") % 50).alias("substation_id"), F.floor("o_totalprice").cast("double").alias("mw_within_radius"), (F.col("o_orderkey") % 100).alias("n_within_radius"))
    return QU.poi_collapse(o)


@q("competition_attach", f"select p.id, c.mw_within_radius as poi_competition_mw, c.n_within_radius as poi_competition_n from (select p.id, t.tid, row_number() over (partition by p.id order by {DIST}, t.tid) as rn from ({PM}) p, ({_SUB_T}) t) p left join ({COMP}) c on c.substation_id = p.tid where rn = 1")
def competition_attach(spark, sf):
    m = materialize(matched(spark, sf), "matched")
    sub = subs_m(spark, sf)
    near = E.nearest_substation(parcel_points(spark, sf), sub)
    return E.competition_attach(near, QU.poi_competition(m, sub)).select("id", "poi_competition_mw", "poi_competition_n")


# --- overlays -------------------------------------------------------------------

FLOOD_HIT = "greatest(p.x0, f.tx) <= p.x1 and greatest(p.y0, f.ty) <= p.y1 and p.x1 >= f.tx and p.y1 >= f.ty and (greatest(p.x0, f.tx) - f.tx) / f.w + (greatest(p.y0, f.ty) - f.ty) / f.h <= 1"


def parcel_boxes(spark, sf):
    return box_layer(view(spark, sf, "parcels").select("id", "x0", "y0", "x1", "y1"))


@q("flood_flag", f"select p.id, count(f.id) > 0 as sfha_flag from parcels p left join floods f on {FLOOD_HIT} group by p.id")
def flood_flag(spark, sf):
    p = parcel_boxes(spark, sf)
    hit = E.flood_flag(p, flood_geo(view(spark, sf, "floods")))
    return p.select("id").join(hit, "id", "left").select("id", F.coalesce("sfha_flag", F.lit(False)).alias("sfha_flag"))


BOX_HIT = "p.x0 <= o.x1 and p.x1 >= o.x0 and p.y0 <= o.y1 and p.y1 >= o.y0"


@q("exclusion_overlay_flags", f"select p.id, bool_or(o.kind = 'protected_area') as excl_protected_area, bool_or(o.kind = 'open_water') as excl_open_water, bool_or(o.kind = 'built_up') as excl_built_up from parcels p join overlays o on {BOX_HIT} group by p.id")
def exclusion_overlay_flags(spark, sf):
    return E.overlay_flags(parcel_boxes(spark, sf), box_layer(view(spark, sf, "overlays")))


@q("polygons_intersect", f"select p.id, count(*) as n, {lng('sum(o.id)')} as ids from parcels p join overlays o on {BOX_HIT} group by p.id")
def polygons_intersect(spark, sf):
    met = BT.meeting_totals(parcel_boxes(spark, sf), box_layer(view(spark, sf, "overlays")), 0.02, "id")
    return met.select("id", "n", F.col("total").alias("ids"))


ZCODE = "coalesce(nullif(rtrim(upper(regexp_extract(trim(zone_code_raw), '^[^( ]+', 0)), '*'), ''), 'OTHER')"
ZONE_AT = f"select p.id, z.id as zone_id, z.code, row_number() over (partition by p.id order by (z.x1 - z.x0) * (z.y1 - z.y0), z.id) as rn from parcels p join (select *, {ZCODE} as code from zones) z on p.x > z.x0 and p.x < z.x1 and p.y > z.y0 and p.y < z.y1"


def zones_geo(spark, sf):
    from landsieve.functions.cleaning import zone_code_norm
    z = view(spark, sf, "zones").withColumn("zone_code", zone_code_norm(F.col("zone_code_raw")))
    return box_layer(z)


@q("zoning_at_point", f"select p.id, z.code as zoning_class from parcels p left join (select * from ({ZONE_AT}) a where rn = 1) z on z.id = p.id")
def zoning_at_point(spark, sf):
    pts = view(spark, sf, "parcels").select("id", F.col("x").alias("clon"), F.col("y").alias("clat"))
    return pts.select("id").join(E.zoning_at_point(pts, zones_geo(spark, sf)), "id", "left")


@q("smallest_containing", f"select id, zone_id as container_id from ({ZONE_AT}) a where rn = 1")
def smallest_containing(spark, sf):
    pts = view(spark, sf, "parcels").select("id", F.col("x").alias("clon"), F.col("y").alias("clat"))
    # Width times height, as the reference text has it.
    z = zones_geo(spark, sf).withColumn("zone_area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).withColumnRenamed("id", "zone_id")
    return S.smallest_container(pts, z, 0.05, "clon", "clat", "id", "zone_area", "zone_id", []).select("id", "container_id")


@q("point_in_polygon", "select id, x > -119.9 and x < -118.1 and y > 34.9 and y < 35.2 or x > -119.9 and x < -119.0 and y > 34.9 and y < 35.6 as inside from parcels")
def point_in_polygon(spark, sf):
    p = view(spark, sf, "parcels").select("id", "x", "y")
    hit = S.points_in_polygons(p, boundary(spark).select("bbox", "edges"), 0.25, "x", "y").select("id", F.lit(True).alias("inside"))
    return p.select("id").join(hit, "id", "left").select("id", F.coalesce("inside", F.lit(False)).alias("inside"))


@q("enrich_assemble", f"""select p.id, s.tid as sub_kv_of, t.dist_cm as tx_cm, g.ghi6, z.code as zoning_class, coalesce(f.hit, false) as sfha_flag, coalesce(o.pa, false) as excl_protected_area, coalesce(o.ow, false) as excl_open_water, coalesce(o.bu, false) as excl_built_up
 from parcels p join (select * from (select p.id, t.tid, row_number() over (partition by p.id order by {DIST}, t.tid) as rn from ({PM}) p, ({_SUB_T}) t) a where rn = 1) s on s.id = p.id
 join ({_TX}) t on t.id = p.id join ({_ghi_sql()}) g on g.id = p.id left join (select * from ({ZONE_AT}) a where rn = 1) z on z.id = p.id
 left join (select p.id, true as hit from parcels p join floods f on {FLOOD_HIT} group by 1) f on f.id = p.id
 left join (select p.id, bool_or(o.kind = 'protected_area') as pa, bool_or(o.kind = 'open_water') as ow, bool_or(o.kind = 'built_up') as bu from parcels p join overlays o on {BOX_HIT} group by p.id) o on o.id = p.id""")
def enrich_assemble(spark, sf):
    """Everything joined at once; each parcel comes back exactly once.

    The station id stands in for its voltage, so the match itself is compared.
    Box centres are used as centroids, as in the reference text.
    """
    p = materialize(parcel_boxes(spark, sf), "boxes", deal=True)
    cent = materialize(parcel_points(spark, sf), "centres", deal=True)
    out = E.assemble(p, cent, subs_m(spark, sf), line_geo(view(spark, sf, "lines")), ghi_grid(spark, sf),
                     flood=flood_geo(view(spark, sf, "floods")), zoning=zones_geo(spark, sf),
                     exclusions=box_layer(view(spark, sf, "overlays")))
    return out.select("id", F.col("sub_id").alias("sub_kv_of"), scaled("dist_tx_m", CM).alias("tx_cm"), scaled("ghi", 1e6).alias("ghi6"),
                      "zoning_class", "sfha_flag", *[f"excl_{k}" for k in K.EXCLUSION_KINDS])


@q("update_from", "select p.id, p.acres, o.n as poi_competition_n from parcels p left join (select o_custkey as id, count(*) as n from orders group by 1) o on o.id = p.id")
def update_from(spark, sf):
    new = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("poi_competition_n"))
    return E.update_from(view(spark, sf, "parcels").select("id", "acres", "poi_competition_n"), new)


@q("polygon_candidates", "select id from parcels where x0 <= -118.1 and x1 >= -119.9 and y0 <= 35.6 and y1 >= 34.9 and (y0 <= 35.2 or x0 <= -119.0)")
def polygon_candidates(spark, sf):
    p = parcels_geo(spark, sf).withColumn("parts", G.box_polygon(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    drawn = G.polygon(F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in L_SHAPE]))
    return SC.candidates(p, (-119.9, 34.9, -118.1, 35.6), drawn).select("id")


@q("exclusions_union", "select kind, count(*) as n from overlays group by 1")
def exclusions_union_(spark, sf):
    o = view(spark, sf, "overlays").select("kind", "id")
    return exclusions_union([o.filter(F.col("kind") == k) for k in ("protected_area", "open_water", "built_up")]).groupBy("kind").agg(F.count("*").alias("n"))


# --- geometry -------------------------------------------------------------------

@q("make_point", f"select id, {s('x', 1e9)} as x9, {s('y', 1e9)} as y9 from parcels")
def make_point(spark, sf):
    p = view(spark, sf, "parcels").select("id", G.point(F.col("x"), F.col("y")).alias("p"))
    return p.select("id", scaled("p.x", 1e9).alias("x9"), scaled("p.y", 1e9).alias("y9"))


_BB = f"select id, {s('tx', 1e9)} as xmin9, {s('ty', 1e9)} as ymin9, {s('tx + w', 1e9)} as xmax9, {s('ty + h', 1e9)} as ymax9"


@q("bbox_struct", f"{_BB} from floods")
def bbox_struct(spark, sf):
    f = flood_geo(view(spark, sf, "floods"))
    return f.select("id", *[scaled(f"bbox.{c}", 1e9).alias(f"{c}9") for c in ("xmin", "ymin", "xmax", "ymax")])


@q("bbox_polygon", f"select id, 5 as n, {s('x0', 1e9)} as x9, {s('y1', 1e9)} as y9 from overlays")
def bbox_polygon(spark, sf):
    o = box_layer(view(spark, sf, "overlays"))
    b = G.bbox(F.col("parts"))
    return o.select("id", G.vertex_count(F.col("parts")).alias("n"), scaled(b["xmin"], 1e9).alias("x9"), scaled(b["ymax"], 1e9).alias("y9"))


@q("geometry_bbox", f"{_BB} from floods")
def geometry_bbox(spark, sf):
    """Box of a geometry given as GeoJSON text."""
    f = flood_geo(view(spark, sf, "floods")).withColumn("g", RD.format_polygon(F.col("parts"), None))
    f = f.withColumn("b", G.bbox(RD.parse_polygon(F.get_json_object("g", "$.type"), F.get_json_object("g", "$.coordinates"))))
    return f.select("id", *[scaled(f"b.{c}", 1e9).alias(f"{c}9") for c in ("xmin", "ymin", "xmax", "ymax")])


@q("vertex_count", "select p.id, cast(5 as int) as n from parcels p union all select -f.id, cast(4 as int) from floods f")
def vertex_count(spark, sf):
    p = parcel_boxes(spark, sf).select("id", G.vertex_count(F.col("parts")).alias("n"))
    f = flood_geo(view(spark, sf, "floods")).select((-F.col("id")).alias("id"), G.vertex_count(F.col("parts")).alias("n"))
    return p.unionByName(f)


@q("geojson_parse", f"select id, {s('w * h / 2.0', 1e12)} as area12 from floods")
def geojson_parse(spark, sf):
    f = flood_geo(view(spark, sf, "floods")).withColumn("g", RD.format_polygon(F.col("parts"), None))
    parts = RD.parse_polygon(F.get_json_object("g", "$.type"), F.get_json_object("g", "$.coordinates"))
    return f.select("id", scaled(G.area(parts), 1e12).alias("area12"))


@q("geojson_format", "select id, 'Point' as kind, cast(floor(x * 1000000 + 0.5) as bigint) as x6 from parcels")
def geojson_format(spark, sf):
    g = view(spark, sf, "parcels").withColumn("g", RD.format_point(F.col("x"), F.col("y")))
    return g.select("id", F.get_json_object("g", "$.type").alias("kind"), scaled(F.get_json_object("g", "$.coordinates[0]").cast("double"), 1e6).alias("x6"))


@q("reproject", f"select id, {s(UX, CM)} as mx_cm, {s(UY, CM)} as my_cm, true as back_ok, true as albers_ok from parcels")
def reproject(spark, sf):
    p = view(spark, sf, "parcels")
    mx, my = P.reproject(F.col("x"), F.col("y"), 4326, 26911)
    p = p.withColumn("mx", mx).withColumn("my", my)
    bx, by = P.reproject(F.col("mx"), F.col("my"), 26911, 4326)
    ax, ay = P.reproject(F.col("mx"), F.col("my"), 26911, 3310)
    p = p.withColumn("ax", ax).withColumn("ay", ay)
    cx, cy = P.reproject(F.col("ax"), F.col("ay"), 3310, 4269)
    ok = (F.abs(cx - F.col("x")) < 1e-9) & (F.abs(cy - F.col("y")) < 1e-9)
    return p.select("id", scaled("mx", CM).alias("mx_cm"), scaled("my", CM).alias("my_cm"), ((F.abs(bx - F.col("x")) < 1e-10) & (F.abs(by - F.col("y")) < 1e-10)).alias("back_ok"), ok.alias("albers_ok"))


@q("area", f"select id, {s('w * h / 2.0', 1e12)} as tri12, {s('w * h / 2.0 - w * h / 32.0', 1e12)} as hole12 from floods")
def area(spark, sf):
    f = flood_geo(view(spark, sf, "floods"))
    x, y, w, h = (F.col(c) for c in ("tx", "ty", "w", "h"))
    hole = F.array(G.point(x + w / 8, y + h / 8), G.point(x + w / 8, y + h * 3 / 8), G.point(x + w * 3 / 8, y + h / 8), G.point(x + w / 8, y + h / 8))
    holed = G.polygon(F.col("parts")[0]["rings"][0], hole)
    return f.select("id", scaled(G.area(F.col("parts")), 1e12).alias("tri12"), scaled(G.area(holed), 1e12).alias("hole12"))


@q("centroid", f"select id, {s('tx + w / 3.0', 1e9)} as x9, {s('ty + h / 3.0', 1e9)} as y9 from floods")
def centroid(spark, sf):
    c = flood_geo(view(spark, sf, "floods")).withColumn("c", G.centroid(F.col("parts")))
    return c.select("id", scaled("c.x", 1e9).alias("x9"), scaled("c.y", 1e9).alias("y9"))


def broken(spark, sf):
    """Overlay boxes, some of them turned into bow-ties, left open or cut short."""
    o = view(spark, sf, "overlays")
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    p = [G.point(x0, y0), G.point(x1, y0), G.point(x1, y1), G.point(x0, y1)]
    k = F.col("id") % 6
    ring = (
        F.when(k == 1, F.array(p[0], p[1], p[3], p[2], p[0])).when(k == 2, F.array(p[0], p[1], p[2], p[3]))
        .when(k == 3, F.array(p[0], p[1], p[0])).otherwise(F.array(p[0], p[1], p[2], p[3], p[0])))
    return o.select("id", "x0", "y0", "x1", "y1", F.when(k != 4, G.polygon(ring)).alias("parts"))


@q("geometry_check", "select id, case id % 6 when 1 then 'self-crossing' when 2 then 'not closed' when 3 then 'too few points' when 4 then 'empty' else 'valid' end as problem from overlays")
def geometry_check(spark, sf):
    return broken(spark, sf).select("id", F.coalesce(G.geometry_problem(F.col("parts")), F.lit("valid")).alias("problem"))


@q("geometry_repair", f"""select id, case when id % 6 in (1, 2) then 'repaired' when id % 6 in (3, 4) then 'quarantined' else 'ok' end as repair,
 case when id % 6 in (3, 4) then null else {s('(x1 - x0) * (y1 - y0) * case when id % 6 = 1 then 0.5 else 1.0 end', 1e10)} end as area10 from overlays""")
def geometry_repair(spark, sf):
    r = RP.geometry_repair(broken(spark, sf))
    return r.select("id", "repair", scaled(G.area(F.col("parts")), 1e10).alias("area10"))


_COVERED = f"""zc as (select {ZCODE} as zone_code, x0, y0, x1, y1 from zones),
 xs as (select zone_code, v as x, lead(v) over (partition by zone_code order by v) as xn from (select distinct zone_code, unnest([x0, x1]) as v from zc) t),
 ys as (select zone_code, v as y, lead(v) over (partition by zone_code order by v) as yn from (select distinct zone_code, unnest([y0, y1]) as v from zc) t),
 hit as (select zone_code, x, xn, y, yn from xs join ys using (zone_code) where xn is not null and yn is not null
  and exists (select 1 from zc where zc.zone_code = xs.zone_code and x0 <= x and x1 >= xn and y0 <= y and y1 >= yn))"""


@q("boundary_union", f"""with {_COVERED}
 select h.zone_code, {s('sum((xn - x) * (yn - y))', 1e6)} as area6, {s('min(x)', 1e6)} as xmin6, {s('max(yn)', 1e6)} as ymax6, max(n) as polygons
 from hit h join (select zone_code, count(*) as n from zc group by 1) c on c.zone_code = h.zone_code group by 1""")
def boundary_union(spark, sf):
    """Union of the polygons of each zone code: area without overlap, and its extent."""
    z = materialize(zones_geo(spark, sf), "zones")
    parts = UN.boundary_union(z, "zone_code", 0.25)
    box = G.bbox_of(F.col("ring"))
    found = parts.groupBy("zone_code").agg(scaled(F.sum("area"), 1e6).alias("area6"), scaled(F.min(box["xmin"]), 1e6).alias("xmin6"),
                                           scaled(F.max(box["ymax"]), 1e6).alias("ymax6"))
    return found.join(z.groupBy("zone_code").agg(F.count("*").alias("polygons")), "zone_code")


def _unit(lo, hi, v0, span):
    """Grid position 0..65535 of the middle of two coordinates."""
    return f"least(greatest(cast(trunc((({lo} + {hi}) / {d(2.0)} - {d(v0)}) / {d(span)} * {d(65536.0)}) as bigint), 0), 65535)"


_WALK = f"""with recursive walk as (
 select id, {_unit('x0', 'x1', -120.21, -117.61 + 120.21)} as hx, {_unit('y0', 'y1', 34.78, 35.82 - 34.78)} as hy, cast(0 as bigint) as pos, cast(32768 as bigint) as side from parcels
 union all
 select id, case when ry = 0 then (case when rx = 1 then 65535 - hy else hy end) else hx end, case when ry = 0 then (case when rx = 1 then 65535 - hx else hx end) else hy end,
  pos + side * side * xor(3 * rx, ry), side // 2
 from (select *, case when hx & side > 0 then 1 else 0 end as rx, case when hy & side > 0 then 1 else 0 end as ry from walk where side > 0) w)"""
CURVE_BOX = (-120.21, 34.78, -117.61, 35.82)


@q("hilbert_index", f"""{_WALK}
select id, pos as hilbert from walk where side = 0""")
def hilbert_index(spark, sf):
    """Curve position of every parcel."""
    p = parcels_geo(spark, sf)
    return O.hilbert_key(p, CURVE_BOX).select("id", "hilbert")


@q("spatial_order", f"""{_WALK}
select (rn - 1) // 500 as file, count(*) as n_rows, min(pos) as first, max(pos) as last, {', '.join(s(f'{f}({c})', 1e9) + f' as {n}9' for f, c, n in (
    ('min', 'x0', 'xmin'), ('min', 'y0', 'ymin'), ('max', 'x1', 'xmax'), ('max', 'y1', 'ymax')))}
from (select w.id, pos, row_number() over (order by pos, w.id) as rn from walk w where side = 0) o join parcels p on p.id = o.id group by 1""")
def spatial_order(spark, sf):
    """Files cut along the curve, and what each of them covers."""
    boxes = O.write_ordered(parcels_geo(spark, sf).select("id", "bbox"), fresh_path(spark, "ordered-files"), 500, extent=CURVE_BOX)
    return boxes.select("file", "n_rows", "first", "last", *[scaled(c, 1e9).alias(f"{c}9") for c in ("xmin", "ymin", "xmax", "ymax")])


@q("grid_points", f"select request_id as box_id, count(*) as n from (select request_id, x0 + i * {d(0.01)} as x, y0 + j * {d(0.01)} as y from requests, range(0, 11) a(i), range(0, 11) b(j) where i <= floor((x1 - x0 + 1e-9) / 0.01) and j <= floor((y1 - y0 + 1e-9) / 0.01)) g where {IN_L} group by 1")
def grid_points(spark, sf):
    """Sample points over each request box, kept where inside the boundary."""
    r = view(spark, sf, "requests").select(F.col("request_id").alias("box_id"), F.struct(
        F.col("x0").alias("xmin"), F.col("y0").alias("ymin"), F.col("x1").alias("xmax"), F.col("y1").alias("ymax")).alias("bbox"))
    pts = R.grid_points(r, 0.01).withColumn("pid", F.concat_ws(":", "box_id", "i", "j"))
    return S.clip_points(pts.drop("bbox"), boundary(spark), 0.25, "lon", "lat", "pid").groupBy("box_id").agg(F.count("*").alias("n"))


# --- raster ---------------------------------------------------------------------

def dem(spark, sf):
    return view(spark, sf, "dem").select(F.col("row_").cast("long").alias("row"), F.col("col_").alias("col"), "z")


def dem_grid(spark, sf, size=30.0):
    rows = dem(spark, sf).agg(F.max("row")).first()[0] + 1
    return R.Grid(0.0, 0.0, size, size, rows, 150)


@q("raster_mosaic", f"select row_ as \"row\", col_ as col, {s('coalesce(case when (row_ * 150 + col_) % 3 <> 0 then z end, z + 1)', 1e3)} as z3 from dem where z is not null")
def raster_mosaic(spark, sf):
    c = dem(spark, sf)
    first = c.withColumn("tile_order", F.lit(0)).filter((F.col("row") * 150 + F.col("col")) % 3 != 0)
    second = c.withColumn("tile_order", F.lit(1)).withColumn("z", F.col("z") + 1)
    return R.raster_mosaic(first.unionByName(second)).select("row", "col", scaled("z", 1e3).alias("z3"))


@q("raster_window", f"select row_ as \"row\", col_ as col, {s('z', 1e3)} as z3 from dem where row_ >= 2 and col_ between 10 and 99")
def raster_window(spark, sf):
    return R.raster_window(dem(spark, sf), 2, 10**9, 10, 99).select("row", "col", scaled("z", 1e3).alias("z3"))


_GRAD = """select o.row_ as "row", o.col_ as col,
 case when o.col_ = 0 then (e.z - o.z) / 30.0 when o.col_ = 149 then (o.z - w.z) / 30.0 else (e.z - w.z) / 60.0 end as dzdx,
 case when o.row_ = 0 then (n.z - o.z) / 30.0 when o.row_ = (select max(row_) from dem) then (o.z - s.z) / 30.0 else (n.z - s.z) / 60.0 end as dzdy
 from dem o left join dem e on e.row_ = o.row_ and e.col_ = o.col_ + 1 left join dem w on w.row_ = o.row_ and w.col_ = o.col_ - 1
 left join dem n on n.col_ = o.col_ and n.row_ = o.row_ + 1 left join dem s on s.col_ = o.col_ and s.row_ = o.row_ - 1 where o.z is not null"""


def gradient(spark, sf):
    g = dem_grid(spark, sf)
    return R.slope_gradient(dem(spark, sf), g.rows, g.cols, g.dx, g.dy)


@q("slope_gradient", f"select \"row\", col, {s('dzdx', 1e6)} as dzdx6, {s('dzdy', 1e6)} as dzdy6 from ({_GRAD}) g")
def slope_gradient(spark, sf):
    return gradient(spark, sf).select("row", "col", scaled("dzdx", 1e6).alias("dzdx6"), scaled("dzdy", 1e6).alias("dzdy6"))


@q("raster_slope", f"select \"row\", col, {s('sqrt(dzdx * dzdx + dzdy * dzdy) * 100.0', 1e6)} as slope6 from ({_GRAD}) g")
def raster_slope(spark, sf):
    return R.raster_slope(gradient(spark, sf)).select("row", "col", scaled("value", 1e6).alias("slope6"))


_MASK = f"select \"row\", col, case when (col + 0.5) * 30 between 300 and 4000 and (\"row\" + 0.5) * 30 >= 45 then sqrt(dzdx * dzdx + dzdy * dzdy) * 100.0 end as v from ({_GRAD}) g"


def masked(spark, sf):
    g = dem_grid(spark, sf)
    ring = G.box_polygon(F.lit(300.0), F.lit(45.0), F.lit(4000.0), F.lit(1e9))
    from landsieve.operators.spatial import polygon_columns
    b = polygon_columns(spark.range(1).select(ring.alias("parts")))
    return R.raster_mask(R.raster_slope(gradient(spark, sf)), g, b, 500.0), g


@q("raster_mask", f"select \"row\", col, {s('v', 1e6)} as v6 from ({_MASK}) m")
def raster_mask(spark, sf):
    return masked(spark, sf)[0].select("row", "col", scaled("value", 1e6).alias("v6"))


@q("raster_stats", f"select {s('min(v)', 1e6)} as min6, {s('max(v)', 1e6)} as max6, {s('avg(v)', 1e6)} as mean6, count(v) as valid_cells, 150 as width, {s('(max(\"row\") + 1) * 30.0', 1)} as top from ({_MASK}) m")
def raster_stats(spark, sf):
    cells, g = masked(spark, sf)
    st = R.raster_stats(cells, g)
    return st.select(scaled("min_slope_pct", 1e6).alias("min6"), scaled("max_slope_pct", 1e6).alias("max6"), scaled("mean_slope_pct", 1e6).alias("mean6"),
                     "valid_cells", "width", scaled("bbox_ymax", 1).alias("top"))


_RES = """select "row", col, sum(w * z) / sum(w) as z from (select t."row", t.col, (case when i = 1 then wr else 1 - wr end) * (case when j = 1 then wc else 1 - wc end) as w, fr0 + i as sr, fc0 + j as sc from
 (select "row", col, floor(fr) as fr0, floor(fc) as fc0, fr - floor(fr) as wr, fc - floor(fc) as wc from (select cast(r as bigint) as "row", cast(c as bigint) as col, (r + cast(0.5 as double)) * 20.0 / 30.0 - 0.5 as fr, (c + cast(0.5 as double)) * 20.0 / 30.0 - 0.5 as fc
  from range(0, (select cast((max(row_) + 1) * 3 / 2 as bigint) from dem)) a(r), range(0, 225) b(c)) f) t, range(0, 2) x(i), range(0, 2) y(j)) p join dem on row_ = sr and col_ = sc and z is not null where w > 0 group by 1, 2"""


@q("raster_resample", f"select \"row\", col, {s('z', 1e6)} as z6 from ({_RES}) r")
def raster_resample(spark, sf):
    src = dem_grid(spark, sf)
    target = R.Grid(0.0, 0.0, 20.0, 20.0, int(src.rows * 3 / 2), 225)
    return R.raster_resample(dem(spark, sf), src, target).select("row", "col", scaled("z", 1e6).alias("z6"))


_TOUCH = """select p.id, c.row_ as "row", c.col_ as col from plots p join (select row_, col_ from dem) c on p.x0 <= (c.col_ + 1) * 30 and p.x1 >= c.col_ * 30 and p.y0 <= (c.row_ + 1) * 30 and p.y1 >= c.row_ * 30"""
_ASSIGN = f"select max(id) as id, \"row\", col from ({_TOUCH}) t group by 2, 3"


def plots(spark, sf):
    return box_layer(view(spark, sf, "plots"))


@q("raster_assign", _ASSIGN)
def raster_assign(spark, sf):
    return R.raster_assign(plots(spark, sf), dem_grid(spark, sf), ["id"])


@q("zonal_mean", f"select a.id, {s('avg(d.z)', 1e6)} as mean6 from ({_ASSIGN}) a join dem d on d.row_ = a.\"row\" and d.col_ = a.col where d.z is not null group by 1")
def zonal_mean(spark, sf):
    a = R.assign_runs(plots(spark, sf), dem_grid(spark, sf), ["id"])
    return R.zonal_mean(a, dem(spark, sf).withColumnRenamed("z", "value")).select("id", scaled("mean_slope_pct", 1e6).alias("mean6"))


@q("two_resolution", f"select p.id, c.mean6 as screen6, f.mean6 as final6 from plots p left join (select a.id, {s('avg(d.z)', 1e6)} as mean6 from ({_TOUCH}) a join dem d on d.row_ = a.\"row\" and d.col_ = a.col where d.z is not null group by 1) c on c.id = p.id left join (select p.id, {s('avg(d.z)', 1e6)} as mean6 from plots p join dem d on p.x0 <= (d.col_ + 1) * 10 and p.x1 >= d.col_ * 10 and p.y0 <= (d.row_ + 1) * 10 and p.y1 >= d.row_ * 10 where d.z is not null group by 1) f on f.id = p.id")
def two_resolution(spark, sf):
    """Coarse grid everywhere, finer grid where it reaches; all touching parcels count."""
    g = dem_grid(spark, sf)
    cells = dem(spark, sf).withColumnRenamed("z", "value")
    fine = R.Grid(0.0, 0.0, 10.0, 10.0, g.rows, g.cols)
    out = R.two_resolution(plots(spark, sf), cells, g, cells, fine, ["id"], "all")
    return out.select("id", scaled("mean_slope_pct", 1e6).alias("screen6"), scaled("mean_slope_pct_final", 1e6).alias("final6"))


# --- tiles ----------------------------------------------------------------------

_TILES = """select id, acres, cast(z as int) as zoom, cast(floor((x + 180.0) / 360.0 * pow(2.0, z)) as bigint) as tile_x,
 cast(floor((1.0 - asinh(tan(radians(y))) / pi()) / 2.0 * pow(2.0, z)) as bigint) as tile_y from parcels, range(8, 17) r(z)"""


@q("tile_assign", f"select id, zoom, tile_x, tile_y from ({_TILES}) t")
def tile_assign(spark, sf):
    return T.tile_assign(view(spark, sf, "parcels"), "x", "y").select("id", "zoom", "tile_x", "tile_y")


def _spread(v):
    for k, m in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = f"((({v}) | (({v}) << {k})) & {m})" if k == 16 else f"(select (x | (x << {k})) & {m} from (select {v} as x) t{k})"
    return v


_CURVE = f"""c as (select id, acres, x, y, cast(floor((x + 180.0) / 360.0 * 4194304.0) as bigint) as u, cast(floor((1.0 - asinh(tan(radians(y))) / pi()) / 2.0 * 4194304.0) as bigint) as v from parcels),
 g as (select *, {_spread('u')} | ({_spread('v')} << 1) as m from c), t as (select *, m >> (44 - 2 * cast(z as int)) as tile, cast(z as int) as zoom from g, range(8, 17) r(z)),
 k as (select *, coalesce(m - lag(m) over (partition by zoom, tile order by m, id), 4611686018427387904) as gap from t)"""


@q("tile_thin", f"""with {_CURVE} select id, zoom, gap, u >> (22 - zoom) as tile_x, v >> (22 - zoom) as tile_y
 from (select *, row_number() over (partition by zoom, tile order by gap desc, id) as pos from k) p where pos <= 50""")
def tile_thin(spark, sf):
    return T.tile_thin(view(spark, sf, "parcels"), "x", "y", 50).select("id", "zoom", "gap", "tile_x", "tile_y")


# --- streams --------------------------------------------------------------------

def usage_stream(spark, sf):
    """The events table as a stream of usage events."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    ev = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    floor = lambda k: F.floor(F.col("value") * k).cast("long")
    u = ev.select(
        "event_id", "ts", F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("client"),
        F.when(F.col("event_type").isin("view", "click", "signup"), "text").otherwise("voice").alias("mode"),
        F.when(F.col("user_id") % 4 == 0, "google:gemini-3.5-flash").when(F.col("user_id") % 4 == 1, "GEMINI-2.5-FLASH-lite")
        .when(F.col("user_id") % 4 == 2, "gemini-x").otherwise("other").alias("model"),
        floor(100).alias("t_in"), floor(10).alias("t_out"), floor(30).alias("t_cached"))
    return with_usage_json(u)


@q("usage_cost_stream", f"select event_id, cost as nano from ({COST}) c")
def usage_cost_stream(spark, sf):
    out, cp = fresh_path(spark, "priced"), fresh_path(spark, "cp")
    ST.write_priced(usage_stream(spark, sf), out, cp).awaitTermination()
    return ST.read_priced(spark, out).select("event_id", scaled("cost_usd", 1e9).alias("nano"))


@q("spend_ledger_stream", f"select client, mode, cast(sum(cost) as bigint) as nano from ({COST}) c where cost > 0 group by 1, 2")
def spend_ledger_stream(spark, sf):
    out, cp = fresh_path(spark, "ledger"), fresh_path(spark, "cp")
    ST.write_ledger(usage_stream(spark, sf), out, cp).awaitTermination()
    return ST.read_ledger(spark, out).select("client", "mode", F.col("spent_nano").alias("nano"))


CAP = 0.3
CAP_NANO = 300_000_000


@q("cap_alert_stream", f"select client, mode, cast(sum(cost) as bigint) as nano from ({COST}) c where cost > 0 group by 1, 2 having sum(cost) >= {CAP_NANO}")
def cap_alert_stream(spark, sf):
    out, cp = fresh_path(spark, "alerts"), fresh_path(spark, "cp")
    ST.write_alerts(usage_stream(spark, sf), out, cp, CAP).awaitTermination()
    return ST.read_alerts(spark, out).select("client", "mode", F.col("spent_nano").alias("nano"))


@q("cap_alert_batch", f"""select client, mode, event_id from (select client, mode, event_id, row_number() over (partition by client, mode order by ts, event_id) as rn from (
 select client, mode, event_id, ts, sum(cost) over (partition by client, mode order by ts, event_id rows unbounded preceding) as run from ({COST}) c where cost > 0) r where run >= {CAP_NANO}) t where rn = 1""")
def cap_alert_batch(spark, sf):
    return U.cap_crossings(U.price_events(usage_rows(spark, sf)), CAP).select("client", "mode", "event_id")
