"""Scoring, aggregation, windows, ordering, set operations, scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from landsieve import constants as K
from landsieve.functions import cleaning as C
from landsieve.functions import geometry as G
from landsieve.operators import economics as EC
from landsieve.operators import ordering as O
from landsieve.operators import places as PL
from landsieve.operators import quality as QL
from landsieve.operators import queue as QU
from landsieve.operators import requests as RQ
from landsieve.operators import results as RS
from landsieve.operators import rules as RU
from landsieve.operators import scoring as SC
from landsieve.operators import usage as U
from landsieve.session import materialize
from suite.q_sources import _MED_SQL, _medians, price_bodies
from suite.registry import lng, q, s, scaled
from suite.tables import box_layer, d, parcels_geo, view

# Factor domains in SQL text: key -> (column, lower-is-better, low, span).
NORM = {"ghi": ("ghi", False, 4.5, 2.0), "slope": ("mean_slope_pct", True, 0.0, 15.0), "tx_distance": ("dist_tx_m", True, 0.0, 20000.0),
        "sub_distance": ("dist_sub_m", True, 0.0, 20000.0), "sub_capacity": ("nearest_sub_kv", False, 0.0, 500.0),
        "acreage": ("acres", False, 0.0, 640.0), "competition": ("poi_competition_mw", True, 0.0, 2000.0)}
SOLAR = {"ghi": 0.25, "slope": 0.20, "tx_distance": 0.20, "sub_distance": 0.15, "acreage": 0.15, "sub_capacity": 0.05}
CENTER = {"tx_distance": 0.25, "sub_capacity": 0.20, "sub_distance": 0.20, "slope": 0.15, "acreage": 0.10, "competition": 0.10}


def norm_sql(key: str) -> str:
    col, low_good, lo, span = NORM[key]
    r = f"least(greatest(({col} - {d(lo)}) / {d(span)}, {d(0.0)}), {d(1.0)})"
    return f"(case when {col} is null then {d(0.5)} else {f'({d(1.0)} - {r})' if low_good else r} end)"


def score_sql(weights: dict[str, float]) -> str:
    total = sum(weights.values())
    return f"{d(100.0)} * (" + " + ".join(f"{d(w / total)} * {norm_sql(k)}" for k, w in weights.items()) + ")"


KEEP_SOLAR = """not (coalesce(acres < 20, false) or coalesce(sfha_flag, false) or coalesce(mean_slope_pct > 15, false)
 or coalesce(zoning_class in ('E', 'P'), false))"""
BOX = (-119.6, 34.9, -118.4, 35.6)
IN_BOX = "x0 <= -118.4 and x1 >= -119.6 and y0 <= 35.6 and y1 >= 34.9"


def parcels(spark, sf):
    return view(spark, sf, "parcels")


@q("factor_norm", "select id, " + ", ".join(f"{s(norm_sql(k), 1e6)} as n_{k}" for k in NORM) + " from parcels")
def factor_norm(spark, sf):
    return parcels(spark, sf).select("id", *[scaled(SC.factor_norm(k), 1e6).alias(f"n_{k}") for k in K.FACTORS])


@q("score", f"select id, {s(score_sql(CENTER), 1e6)} as score6 from parcels")
def score(spark, sf):
    return parcels(spark, sf).select("id", scaled(SC.score_raw(SC.resolve_weights("data_center")), 1e6).alias("score6"))


@q("score_topk", f"""select id, row_number() over (order by raw desc, id) + 10 as rank, {s('raw', 1e6)} as score6 from (
 select id, {score_sql(SOLAR)} as raw from parcels where {IN_BOX} and {KEEP_SOLAR} order by raw desc, id limit 200 offset 10) t""")
def score_topk(spark, sf):
    cand = SC.candidates(parcels_geo(spark, sf), BOX)
    top = SC.score_topk(cand, "utility_solar", prohibited=["E", "P"], limit=200, offset=10)
    # The page holds at most 200 rows, so one window over it is small.
    w = Window.orderBy(F.desc("score_raw"), F.asc("id"))
    return top.select("id", (F.row_number().over(w) + 10).alias("rank"), scaled("score_raw", 1e6).alias("score6"))


def request_rows(spark, sf):
    r = view(spark, sf, "requests")
    w = F.map_filter(F.create_map(F.lit("ghi"), F.col("o_ghi"), F.lit("competition"), F.col("o_competition")), lambda k, v: v.isNotNull())
    return r.withColumn("weights", F.when(F.col("o_ghi").isNotNull(), w)).withColumn(
        "prohibited", F.when(F.col("own_codes"), F.array(F.lit("A"), F.lit("P"))))


def _w(case_of, key):
    """Effective weight of a factor in SQL text."""
    solar, center = SOLAR.get(key, 0.0), CENTER.get(key, 0.0)
    base = f"case when use_case = 'utility_solar' then {d(solar)} else {d(center)} end"
    return f"coalesce(o_{key}, {base})" if key in ("ghi", "competition") else base


RESOLVED = ("select *, " + ", ".join(f"raw_{k} / total as w_{k}" for k in NORM)
            + ", coalesce(t_min_acres, case when use_case = 'utility_solar' then 20 else 5 end) as min_acres, coalesce(t_max_slope_pct, 15) as max_slope_pct,"
            + " coalesce(t_exclude_sfha, true) as exclude_sfha, coalesce(t_optional, false) as apply_optional from (select *, "
            + " + ".join(f"raw_{k}" for k in NORM) + " as total from (select *, " + ", ".join(f"{_w(None, k)} as raw_{k}" for k in NORM) + " from requests) a) b")


@q("resolve_weights", "select request_id, " + ", ".join(f"{s('w_' + k, 1e6)} as w_{k}" for k in NORM) + f" from ({RESOLVED}) r")
def resolve_weights(spark, sf):
    r = SC.request_columns(request_rows(spark, sf))
    return r.select("request_id", *[scaled(f"w_{k}", 1e6).alias(f"w_{k}") for k in K.FACTORS])


@q("resolve_thresholds", f"select request_id, cast(min_acres as double) as min_acres, cast(max_slope_pct as double) as max_slope_pct, exclude_sfha, apply_optional from ({RESOLVED}) r")
def resolve_thresholds(spark, sf):
    return SC.request_columns(request_rows(spark, sf)).select("request_id", "min_acres", "max_slope_pct", "exclude_sfha", "apply_optional")


def demo_rules(spark):
    return spark.createDataFrame([("E", "solar", "prohibited"), ("R-1", "solar", "prohibited"), ("R-1", "data_center", "prohibited"),
                                  ("C-2", "data_center", "prohibited"), ("A", "solar", "conditional")], "zone_code string, use_case string, permission string")


# Every third area is the lower left half of its box; every thirteenth request can't be scored.
IN_AREA = ("(r.request_id % 3 <> 0 or (greatest(p.x0, r.x0) - r.x0) * (r.y1 - r.y0) + (greatest(p.y0, r.y0) - r.y0) * (r.x1 - r.x0)"
           " <= (r.x1 - r.x0) * (r.y1 - r.y0))")
SCORED = "r.request_id % 13 <> 4"
BATCH_SCORE = f"{d(100.0)} * (" + " + ".join(f"case when w_{k} > 0 then w_{k} * {norm_sql(k)} else 0.0 end" for k in NORM) + ")"
BATCH = f"""
select request_id, id, raw, row_number() over (partition by request_id order by raw desc, id) as rank, "limit" as lim, "offset" as off_ from (
 select r.request_id, p.id, {BATCH_SCORE} as raw, r."limit", r."offset" from ({RESOLVED}) r join parcels p on p.x0 <= r.x1 and p.x1 >= r.x0 and p.y0 <= r.y1 and p.y1 >= r.y0
 where {IN_AREA} and {SCORED} and not (coalesce(acres < min_acres, false) or (exclude_sfha and coalesce(sfha_flag, false)) or coalesce(mean_slope_pct > r.max_slope_pct, false)
  or (apply_optional and (coalesce(excl_protected_area, false) or coalesce(excl_open_water, false) or coalesce(excl_built_up, false)))
  or coalesce(case when own_codes then zoning_class in ('A', 'P') when use_case = 'utility_solar' then zoning_class in ('E', 'R-1') else zoning_class in ('R-1', 'C-2') end, false))) t"""
BATCH_PAGE = f"select request_id, id, {s('raw', 1e6)} as score6, rank from ({BATCH}) p where rank > off_ and rank <= off_ + lim"


def batch_pages(spark, sf):
    rows = request_rows(spark, sf)
    k = F.col("request_id")
    odd = F.when(k % 39 == 4, F.create_map(F.lit("ghi"), F.lit(-1.0))).when(k % 39 == 17, F.create_map(F.lit("nope"), F.lit(1.0)))
    zero = F.map_from_arrays(F.array(*[F.lit(f) for f in K.FACTORS]), F.array(*[F.lit(0.0) for _ in K.FACTORS]))
    rows = rows.withColumn("weights", F.when(k % 13 == 4, F.coalesce(odd, zero)).otherwise(F.col("weights")))
    reqs = SC.request_columns(rows, demo_rules(spark))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    half = G.polygon(F.array(G.point(x0, y0), G.point(x1, y0), G.point(x0, y1), G.point(x0, y0)))
    parts = F.when(k % 3 == 0, half).otherwise(G.box_polygon(x0, y0, x1, y1))
    reqs = reqs.withColumns({
        "bbox": F.struct(x0.alias("xmin"), y0.alias("ymin"), x1.alias("xmax"), y1.alias("ymax")),
        "edges": G.edges(parts), "anchors": G.anchors(parts)}).drop("x0", "y0", "x1", "y1", "weights")
    land = parcels_geo(spark, sf)
    own = G.box_polygon(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return reqs, SC.batch_score(land.withColumns({"edges": G.edges(own), "anchors": G.anchors(own)}), reqs, 0.1)


@q("batch_score", BATCH_PAGE)
def batch_score(spark, sf):
    return batch_pages(spark, sf)[1].select("request_id", "id", scaled("score_raw", 1e6).alias("score6"), "rank")


@q("page_rank", f"""select request_id, id, off_ + row_number() over (partition by request_id order by raw desc, id) as rank from ({BATCH}) p where rank > off_ and rank <= off_ + lim""")
def page_rank(spark, sf):
    reqs, page = batch_pages(spark, sf)
    ranked = RS.page_rank(page.select("request_id", "id", "score_raw")).join(reqs.select("request_id", "offset"), "request_id")
    return ranked.select("request_id", "id", (F.col("offset") + F.col("rank")).cast("long").alias("rank"))


@q("result_meta", f"""select r.request_id, r.use_case, {s('w_ghi', 1e4)} as w_ghi4, cast(min_acres as double) as min_acres,
  case when own_codes then 'A,P' when r.use_case = 'utility_solar' then 'E,R-1' else 'C-2,R-1' end as prohibited,
  coalesce(c.n, 0) as count from ({RESOLVED}) r left join (select request_id, count(*) as n from ({BATCH}) p where rank > off_ and rank <= off_ + lim group by 1) c on c.request_id = r.request_id where {SCORED}""")
def result_meta(spark, sf):
    reqs, page = batch_pages(spark, sf)
    m = RS.result_meta(reqs, page)
    return m.select("request_id", "use_case", scaled(F.coalesce(F.col("weights")["ghi"], F.lit(0.0)), 1e4).alias("w_ghi4"), "min_acres",
                    F.array_join("prohibited", ",").alias("prohibited"), "count")


FACTOR_ROWS = " union all ".join(
    f"select id, {i} as pos, '{k}' as key, {d(w)} * {norm_sql(k)} * {d(100.0)} as contribution, {NORM[k][0]} is not null as known from parcels"
    for i, (k, w) in enumerate(SOLAR.items()))


def cents(expr):
    """Decimal text rounded half up to two places, in hundredths."""
    return f"cast(round(cast(cast({expr} as string) as decimal(30,22)), 2) * 100 as bigint)"


@q("breakdown", f"select id, key, {cents('contribution')} as contribution2, known from ({FACTOR_ROWS}) f")
def breakdown(spark, sf):
    b = SC.breakdown(SC.resolve_weights("utility_solar"))
    return parcels(spark, sf).select("id", F.inline(b)).select("id", "key", scaled("contribution", 1e2).alias("contribution2"), "known")


ORDERED = f"select id, key, known, row_number() over (partition by id order by {cents('contribution')} desc, pos) as rn from ({FACTOR_ROWS}) f"


@q("factor_order", f"select id, string_agg(key, ',' order by rn) as keys from ({ORDERED}) o group by id")
def factor_order(spark, sf):
    b = SC.breakdown(SC.resolve_weights("utility_solar"))
    return parcels(spark, sf).select("id", F.array_join(F.transform(b, lambda f: f["key"]), ",").alias("keys"))


@q("top_factors", f"select id, string_agg(key, ',' order by rn) as keys from ({ORDERED}) o where rn <= 3 group by id")
def top_factors(spark, sf):
    b = SC.top_factors(SC.breakdown(SC.resolve_weights("utility_solar")))
    return parcels(spark, sf).select("id", F.array_join(F.transform(b, lambda f: f["key"]), ",").alias("keys"))


LABEL = "case key when 'ghi' then 'solar resource (ghi)' when 'slope' then 'terrain slope' when 'tx_distance' then 'distance to transmission line' when 'sub_distance' then 'distance to substation' when 'sub_capacity' then 'nearest substation voltage' else 'parcel size' end"


@q("why_this_rank", f"""select id, concat('Driven mainly by ', string_agg({LABEL}, ' and ' order by rn) filter (where rn <= 2), '.',
  case when count(*) filter (where not known) > 0 then concat(' Data was unavailable for ', string_agg({LABEL}, ', ' order by rn) filter (where not known), ' (scored neutrally).') else '' end) as why
  from ({ORDERED}) o group by id""")
def why_this_rank(spark, sf):
    b = SC.breakdown(SC.resolve_weights("utility_solar"))
    return parcels(spark, sf).withColumn("f", b).select("id", SC.why_this_rank(F.col("f")).alias("why"))


# --- queue ----------------------------------------------------------------------

ACTIVE = "(status is not null and status not in ('Withdrawn', 'Completed', 'IN SERVICE since'))"
MW = "(case when queue_id % 9 = 8 then null else cast(replace(replace(capacity_text, ',', ''), ' MW', '') as double) end)"
KERN = "county in ('Kern', ' kern county', 'Los Angeles, Kern')"
QUEUE = f"select queue_id, generation_type, status, {ACTIVE} as is_active, {MW} as mw, poi_name, volt_text from queue_raw where {KERN}"


def queue(spark, sf):
    r = view(spark, sf, "queue_raw").filter(C.mentions_county(F.col("county")))
    return r.select("queue_id", "generation_type", "status", C.is_active(F.col("status")).alias("is_active"),
                    C.num_clean(F.col("capacity_text")).alias("capacity_mw"), "poi_name",
                    C.voltage_known(C.num_clean(F.col("volt_text"))).alias("source_voltage_kv"))


AGG = "count(*) as n_projects, coalesce(sum(mw), 0) as total_mw, count(*) filter (where is_active) as active_n_projects, coalesce(sum(mw) filter (where is_active), 0) as active_total_mw"
SUMMARY = f"""select 'total' as category, 'all' as key, {AGG} from ({QUEUE}) q
 union all select 'by_type', coalesce(nullif(generation_type, ''), 'Unknown'), {AGG} from ({QUEUE}) q group by 2
 union all select 'by_status', coalesce(nullif(status, ''), 'Unknown'), {AGG} from ({QUEUE}) q group by 2"""


@q("queue_summary", SUMMARY)
def queue_summary(spark, sf):
    return QU.queue_summary(queue(spark, sf))


@q("summary_union", SUMMARY)
def summary_union(spark, sf):
    return QU.summary_union(queue(spark, sf))


@q("summary_order", f"select row_number() over (order by category, key) as pos, category, key from ({SUMMARY}) s")
def summary_order(spark, sf):
    # One row per distinct type and status.
    return QU.queue_summary(queue(spark, sf)).select(
        F.row_number().over(Window.orderBy("category", "key")).cast("long").alias("pos"), "category", "key")


@q("conditional_agg", f"select generation_type, count(*) filter (where is_active) as n_active, coalesce(sum(mw) filter (where is_active), 0) as mw_active from ({QUEUE}) q group by 1")
def conditional_agg(spark, sf):
    return QU.active_by(queue(spark, sf), "generation_type")


@q("queue_context", f"""select string_agg(key, ',' order by coalesce(total_mw, 0) desc, key) filter (where category = 'by_type') as types,
 string_agg(key, ',' order by coalesce(total_mw, 0) desc, key) filter (where category = 'by_status') as statuses, max(n_projects) filter (where category = 'total') as n from ({SUMMARY}) s""")
def queue_context(spark, sf):
    c = QU.queue_context(QU.queue_summary(queue(spark, sf)))
    return c.select(F.array_join("by_type.key", ",").alias("types"), F.array_join("by_status.key", ",").alias("statuses"), F.col("total.n_projects").alias("n"))


@q("context_order", f"select category, key, row_number() over (partition by category order by coalesce(total_mw, 0) desc, key) as pos from ({SUMMARY}) s")
def context_order(spark, sf):
    return QU.context_order(QU.queue_summary(queue(spark, sf))).select("category", "key", "pos")


@q("coverage_counts", f"select count(*) as n, count(*) filter (where is_active) as active, count(mw) as with_mw, count(*) filter (where poi_name is null) as no_poi from ({QUEUE}) q")
def coverage_counts(spark, sf):
    return QU.queue_coverage(queue(spark, sf))


@q("enrich_summary", "select count(*) as parcels, count(mean_slope_pct) as with_slope, count(zoning_class) as zoning_classified, count(*) filter (where sfha_flag) as sfha_parcels from parcels")
def enrich_summary(spark, sf):
    from landsieve.operators.enrich import enrich_summary as es
    return es(parcels(spark, sf))


@q("distinct_zones", "select count(distinct upper(trim(fld_zone))) as zones from floods")
def distinct_zones(spark, sf):
    return QL.distinct_zones(view(spark, sf, "floods"))


@q("distinct_codes", "select distinct zone_code from zone_codes")
def distinct_codes(spark, sf):
    return RU.distinct_codes(view(spark, sf, "zone_codes"))


@q("distinct_sorted", "select use_case, string_agg(distinct zone_code, ',' order by zone_code) as codes from rules group by 1")
def distinct_sorted(spark, sf):
    return RU.distinct_sorted(view(spark, sf, "rules")).select("use_case", F.array_join("codes", ",").alias("codes"))


@q("grid_mean", f"select {s('avg(avg_ghi)', 1e3)} as mean_ghi3 from solar")
def grid_mean(spark, sf):
    return QL.grid_mean(view(spark, sf, "solar")).select(scaled("mean_ghi", 1e3).alias("mean_ghi3"))


@q("layer_extent", f"select {s('min(x0)', 1e9)} as xmin9, {s('min(y0)', 1e9)} as ymin9, {s('max(x1)', 1e9)} as xmax9, {s('max(y1)', 1e9)} as ymax9 from parcels")
def layer_extent(spark, sf):
    return O.layer_extent(parcels_geo(spark, sf)).select(*[scaled(c, 1e9).alias(f"{c}9") for c in ("xmin", "ymin", "xmax", "ymax")])


@q("rules_pivot", "select use_case, permission, string_agg(distinct zone_code, ',' order by zone_code) as codes from rules group by 1, 2")
def rules_pivot(spark, sf):
    return RU.rules_pivot(view(spark, sf, "rules")).withColumn("codes", F.array_join("codes", ","))


REQUIRED = "select zone_code, use_case from zone_codes, (values ('solar'), ('wind'), ('storage'), ('data_center')) u(use_case)"


@q("rules_gap_fill", f"select n.zone_code, n.use_case, coalesce(r.permission, 'conditional') as permission, r.permission is null as filled, coalesce(z.zone_name, '') as zone_name from ({REQUIRED}) n left join rules r on r.zone_code = n.zone_code and r.use_case = n.use_case left join (select zone_code, min(zone_name) as zone_name from rules group by 1) z on z.zone_code = n.zone_code")
def rules_gap_fill(spark, sf):
    return RU.rules_gap_fill(view(spark, sf, "zone_codes"), view(spark, sf, "rules")).select(
        "zone_code", "use_case", "permission", (F.col("basis") == K.ZONING_DEFAULT_BASIS).alias("filled"), "zone_name")


@q("rules_gaps", f"select n.zone_code, n.use_case from ({REQUIRED}) n where not exists (select 1 from rules r where r.zone_code = n.zone_code and r.use_case = n.use_case)")
def rules_gaps(spark, sf):
    return RU.rules_gaps(view(spark, sf, "zone_codes"), view(spark, sf, "rules"))


@q("prohibited_join", "select id, coalesce(zoning_class in ('E', 'R-1'), false) as excl_zoning from parcels")
def prohibited_join(spark, sf):
    return RU.prohibited_join(parcels(spark, sf), demo_rules(spark), "solar").select("id", "excl_zoning")


# --- windows, ids, ordering -----------------------------------------------------

@q("surrogate_id", "select o_orderkey, row_number() over (order by o_orderkey) as id from orders")
def surrogate_id(spark, sf):
    return O.ordered_id(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey"), ["o_orderkey"]).select("o_orderkey", "id")


@q("ordered_id", "select id as grid_id, row_number() over (order by lat, lon, id) as id from solar")
def ordered_id(spark, sf):
    return O.ordered_id(view(spark, sf, "solar").withColumnRenamed("id", "grid_id"), ["lat", "lon", "grid_id"]).select("grid_id", "id")


@q("result_sorts", "select id, row_number() over (order by mean_slope_pct nulls last, id) as by_slope, row_number() over (order by coalesce(acres, 0) desc, id) as by_acres from parcels")
def result_sorts(spark, sf):
    """Positions under two of the orders, numbered in parallel."""
    p = parcels(spark, sf)
    a = O.ordered_id(p.select("id", "mean_slope_pct"), [F.asc_nulls_last("mean_slope_pct"), F.asc("id")], "by_slope").select("id", "by_slope")
    b = O.ordered_id(p.select("id", "acres"), [F.desc(F.coalesce("acres", F.lit(0.0))), F.asc("id")], "by_acres").select("id", "by_acres")
    return a.join(b, "id")


@q("result_page", "select id from parcels order by dist_tx_m nulls last, id limit 20 offset 40")
def result_page(spark, sf):
    return RS.result_page(parcels(spark, sf).withColumn("score_raw", F.lit(0.0)), "tx", 2).select("id")


@q("compare_set", """select attribute, max(v) filter (where id = 10) as a, max(v) filter (where id = 20) as b, max(v) filter (where id = 30) as c from (
 select id, 'zoning_class' as attribute, zoning_class as v from parcels where id in (10, 20, 30) union all select id, 'sfha_flag', cast(sfha_flag as string) from parcels where id in (10, 20, 30)) t group by 1""")
def compare_set(spark, sf):
    return RS.compare_set(parcels(spark, sf), [10, 20, 30], ["zoning_class", "sfha_flag"]).select(
        "attribute", F.col("10").alias("a"), F.col("20").alias("b"), F.col("30").alias("c"))


@q("report_set", f"""select id, {s(score_sql(SOLAR), 1e6)} as score6, (select count(*) from ({QUEUE}) q) as context_n from parcels
 where id in (select event_id * 3 + 1 from events) order by {score_sql(SOLAR)} desc, id limit 25""")
def report_set(spark, sf):
    p = parcels(spark, sf).withColumn("score_raw", SC.score_raw(SC.resolve_weights("utility_solar")))
    want = spark.read.parquet(f"{sf}/events.parquet").select((F.col("event_id") * 3 + 1).alias("id"))
    ranked = p.withColumn("rank", F.struct((-F.col("score_raw")).alias("a"), F.col("id").alias("b")))
    ctx = QU.queue_context(QU.queue_summary(queue(spark, sf)))
    return RS.report_set(ranked, want, "utility_solar", ctx).select(
        "id", scaled("score_raw", 1e6).alias("score6"), F.get_json_object("context", "$.total.n_projects").cast("long").alias("context_n"))


@q("request_dedupe", f"select request_id, min(request_id) over (partition by o_custkey, o_orderstatus) as answered_by from (select o_orderkey as request_id, o_custkey, o_orderstatus from orders) r")
def request_dedupe(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    x = F.col("o_custkey").cast("double")
    w = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("slope"), F.lit(0.2), F.lit("ghi"), F.lit(0.3))).otherwise(
        F.create_map(F.lit("ghi"), F.lit(0.30000000001), F.lit("slope"), F.lit(0.2)))
    r = o.select(F.col("o_orderkey").alias("request_id"), RQ.request_key(
        G.box_polygon(x, x, x + 1, x + 1), F.col("o_orderstatus"), w, F.struct(F.lit(5.0).alias("min_acres")),
        F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("A"), F.lit("E"))).otherwise(F.array(F.lit("E"), F.lit("A"))), F.lit(5), F.lit(0)).alias("key"))
    return RQ.request_dedupe(r)[1].select("request_id", "answered_by")


# --- scalars --------------------------------------------------------------------

@q("apn_norm", "select id, regexp_replace(upper(trim(apn)), '[^A-Z0-9]', '', 'g') as apn_norm from parcels")
def apn_norm(spark, sf):
    return parcels(spark, sf).select("id", C.apn_norm(F.col("apn")).alias("apn_norm"))


@q("zone_code_norm", "select id, coalesce(nullif(rtrim(upper(regexp_extract(trim(zone_code_raw), '^[^( ]+', 0)), '*'), ''), 'OTHER') as zone_code from zones")
def zone_code_norm(spark, sf):
    return view(spark, sf, "zones").select("id", C.zone_code_norm(F.col("zone_code_raw")).alias("zone_code"))


def norm_name_sql(c):
    noise = "SUBSTATION|SUBSTATIONS|SUB|STATION|SWITCHYARD|SWITCHING|SWYD|TAP|JCT|JUNCTION|KV"
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper({c}), '[^A-Z0-9]+', ' ', 'g'), '[0-9]+', ' ', 'g'), "
            f"'\\b({noise})\\b', ' ', 'g'), '\\s+', ' ', 'g'))")


@q("station_name_norm", f"select queue_id, {norm_name_sql('poi_name')} as norm from queue_raw")
def station_name_norm(spark, sf):
    return view(spark, sf, "queue_raw").select("queue_id", C.station_name_norm(F.col("poi_name")).alias("norm"))


@q("num_clean", f"select queue_id, {MW} as mw from queue_raw")
def num_clean(spark, sf):
    return view(spark, sf, "queue_raw").select("queue_id", C.num_clean(F.col("capacity_text")).alias("mw"))


@q("num_try", "select k, try_cast(value_text as double) as v from prices")
def num_try(spark, sf):
    return view(spark, sf, "prices").select("k", C.num_try(F.col("value_text")).alias("v"))


@q("voltage_clean", "select id, max_voltage_kv as kv from substations")
def voltage_clean(spark, sf):
    return view(spark, sf, "substations").select("id", C.voltage_known(C.num_try(F.col("raw_kv").cast("string"))).alias("kv"))


@q("acres", f"select o_orderkey, {s('o_totalprice / 4046.8564224', 1e6)} as acres6 from orders")
def acres(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", scaled(C.acres(F.col("o_totalprice")), 1e6).alias("acres6"))


AFF = "(1.0 - least(greatest((o_totalprice * 2 - 150000.0) / 450000.0, 0.0), 1.0))"


@q("affordability_score", f"select o_orderkey, case when o_orderkey % 9 = 0 then null else {s(AFF, 1e6)} end as aff6 from orders")
def affordability_score(spark, sf):
    m = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") * 2)
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", scaled(EC.affordability_score(m), 1e6).alias("aff6"))


@q("affordability_band", f"select o_orderkey, case when o_orderkey % 9 = 0 then 'unknown' when {AFF} >= 0.6 then 'affordable' when {AFF} >= 0.35 then 'moderate' else 'expensive' end as band from orders")
def affordability_band(spark, sf):
    m = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") * 2)
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", EC.affordability_band(EC.affordability_score(m)).alias("band"))


@q("affordability_blend", f"select id, cast(round(round(0.88 * ({score_sql(SOLAR)}) + 0.12 * 100.0 * ((id % 100) / 99.0), 1) * 10) as bigint) as blended1 from parcels")
def affordability_blend(spark, sf):
    sc = SC.score_raw(SC.resolve_weights("utility_solar"))
    return parcels(spark, sf).select("id", scaled(EC.affordability_blend(sc, F.col("id") % 100 / 99.0), 10).alias("blended1"))


SERIES = "select county, yr, max(cast(value_text as double)) as value from prices where value_text not in ('.', '') group by 1, 2"
YOY = f"select county, yr, value, row_number() over (partition by county order by yr desc) as rn, lag(value) over (partition by county order by yr) as prev from ({SERIES}) s"

TREND = "cast(round(round((value - prev) / nullif(prev, 0) * 100.0, 1) * 10) as bigint)"


def price_series(spark, sf):
    p = EC.price_series_parse(price_bodies(spark, sf))
    return p.groupBy("county", "date").agg(F.max("value").alias("value"))


@q("price_yoy", f"select county, concat(cast(yr as string), '-01-01') as as_of, round(value, 2) as hpi_index, {TREND} as yoy1 from ({YOY}) y where rn = 1")
def price_yoy(spark, sf):
    return EC.price_yoy(price_series(spark, sf)).select("county", "as_of", "hpi_index", scaled("yoy_pct", 10).alias("yoy1"))


@q("affordability_summary", f"""select coalesce(m.county, t.county) as county, m.median_home_value_usd, cast(t.yr as string) as hpi_as_of, round(t.value, 2) as hpi_index, t.trend as trend1,
 case when m.median_home_value_usd is null then 'unknown' when m.median_home_value_usd <= 330000 then 'affordable' when m.median_home_value_usd <= 442500 then 'moderate' else 'expensive' end as affordability_band
 from ({_MED_SQL.replace("value_text <> 'null'", "value_text <> 'null' and k % 11 <> 0")}) m full outer join (select *, {TREND} as trend from ({YOY}) y where rn = 1) t on t.county = m.county""")
def affordability_summary(spark, sf):
    out = EC.affordability_summary(EC.median_value_parse(_medians(spark, sf)), EC.price_yoy(price_series(spark, sf)))
    return out.select("county", "median_home_value_usd", "hpi_as_of", "hpi_index", "affordability_band",
                      scaled("price_trend_yoy_pct", 10).alias("trend1"))


PN = "regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')"


@q("place_norm", f"select request_id, trim({PN}, ' ,.') as norm from texts")
def place_norm(spark, sf):
    return view(spark, sf, "texts").select("request_id", C.place_norm(F.col("text")).alias("norm"))


@q("numbers_from_text", "select doc_id, len(regexp_extract_all(text, '[-+]?\\d+(?:\\.\\d+)?')) as n, array_to_string(regexp_extract_all(text, '[-+]?\\d+(?:\\.\\d+)?'), '|') as numbers from documents")
def numbers_from_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    raw = F.regexp_extract_all("text", F.lit(PL.NUMBER), F.lit(0))
    return docs.select("doc_id", F.size(PL.numbers_from_text(F.col("text"))).alias("n"), F.array_join(raw, "|").alias("numbers"))


_PLACE_CASE = f"""case c when 0 then 'county' when 1 then 'mojave' when 2 then 'california city' when 3 then 'bbox' when 4 then 'point' when 6 then 'lake isabella'
 when 7 then 'point' when 9 then 'ridgecrest' when 10 then 'taft' when 11 then 'bbox' when 13 then 'wasco' else null end"""


@q("place_resolve", f"select request_id, {_PLACE_CASE} as what, case c when 0 then -120200000 when 1 then -118234000 when 2 then -118046000 when 3 then -119000000 - (request_id % 10) * 100000 when 4 then -119260000 when 6 then -118533000 when 7 then -119080000 when 9 then -117731000 when 10 then -119516000 when 11 then -119500000 when 13 then -119401000 else null end as xmin6 from (select request_id, request_id % 14 as c from texts) t")
def place_resolve(spark, sf):
    r = PL.place_resolve(view(spark, sf, "texts"))
    what = F.when(F.col("source").isin("bbox", "point", "county"), F.col("source")).otherwise(F.col("place"))
    return r.select("request_id", what.alias("what"), scaled("box.xmin", 1e6).alias("xmin6"))


FOUND = f"""select t.request_id, b.place, b.x - 0.06 as bx0, b.y - 0.06 as by0, b.x + 0.06 as bx1, b.y + 0.06 as by1 from (select request_id, {_PLACE_CASE.replace('case c', 'case request_id % 14')} as place from texts) t
 join (values ('mojave', -118.174::double, 35.052::double), ('california city', -117.986, 35.126), ('lake isabella', -118.473, 35.614), ('ridgecrest', -117.671, 35.622), ('taft', -119.456, 35.142), ('wasco', -119.341, 35.594)) b(place, x, y) on b.place = t.place"""


@q("find_sites", f"""select place, least(count, 200) as count, id, score, rank from (select place, id, {s(score_sql(SOLAR), 1)} as score, count(*) over (partition by place) as count, row_number() over (partition by place order by {score_sql(SOLAR)} desc, id) as rank
 from (select distinct place, bx0, by0, bx1, by1 from ({FOUND}) f) f join parcels p on x0 <= bx1 and x1 >= bx0 and y0 <= by1 and y1 >= by0 where {KEEP_SOLAR}) t where rank <= 3""")
def find_sites(spark, sf):
    """Resolve the texts, answer each distinct area once, report page size and best three."""
    r = PL.place_resolve(view(spark, sf, "texts")).filter("source = 'gazetteer'")
    areas = r.groupBy("place").agg(F.min("box").alias("bbox"))
    no_map = F.lit(None).cast("map<string,double>")
    reqs = SC.request_columns(areas.select(
        F.col("place").alias("request_id"), F.lit("utility_solar").alias("use_case"), "bbox", no_map.alias("weights"), F.lit(None).cast("double").alias("t_min_acres"),
        F.lit(None).cast("double").alias("t_max_slope_pct"), F.lit(None).cast("boolean").alias("t_exclude_sfha"), F.lit(None).cast("boolean").alias("t_optional"),
        F.array(F.lit("E"), F.lit("P")).alias("prohibited"), F.lit(K.DEFAULT_LIMIT).alias("limit"), F.lit(0).alias("offset"))).drop("weights")
    hits = materialize(SC.batch_score(parcels_geo(spark, sf), reqs, 0.1, exact=False), "sites")
    n = hits.groupBy("request_id").agg(F.count("*").alias("count"))
    return hits.filter("rank <= 3").join(n, "request_id").select(
        F.col("request_id").alias("place"), "count", "id", scaled("score_raw", 1).alias("score"), "rank")


@q("round_coords", f"select id, {s('x0', 1e6)} as x6, {s('y1', 1e6)} as y6 from parcels")
def round_coords(spark, sf):
    parts = G.round_coords(G.box_polygon(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    b = G.bbox(parts)
    return parcels(spark, sf).select("id", scaled(b["xmin"], 1e6).alias("x6"), scaled(b["ymax"], 1e6).alias("y6"))


# --- usage ----------------------------------------------------------------------

# Prices in nano-dollars per token, so that sums are exact in both engines.
RATE = """case when lower(model) like '%gemini-3.5-flash%' then [1500, 9000, 150] when lower(model) like '%gemini-2.5-flash%' then [300, 2500, 75] else [1500, 9000, 150] end"""
COST = f"""select event_id, ts, client, mode, cast(case when mode = 'text' then (t_in - least(t_cached, t_in)) * r[1] + least(t_cached, t_in) * r[3] + t_out * r[2]
 else greatest(t_in - t_cached, 0) * 35000 + t_cached * 400 + t_out * 64000 end as bigint) as cost from (select *, {RATE} as r from usage) u"""


def usage_rows(spark, sf):
    u = view(spark, sf, "usage")
    return with_usage_json(u)


def with_usage_json(u):
    text = F.to_json(F.struct(F.col("t_in").alias("input_tokens"), F.col("t_out").alias("output_tokens"), F.col("t_cached").alias("cache_read_tokens")))
    voice = F.to_json(F.struct(
        F.struct(F.col("t_in").alias("audio_tokens"), F.col("t_cached").alias("cached_tokens")).alias("input_token_details"), F.col("t_out").alias("output_tokens")))
    return u.select("event_id", "ts", "client", "mode", "model", F.when(F.col("mode") == "text", text).otherwise(voice).alias("usage"))


@q("token_cost", f"select event_id, cost as nano from ({COST}) c")
def token_cost(spark, sf):
    return U.price_events(usage_rows(spark, sf)).select("event_id", scaled("cost_usd", 1e9).alias("nano"))
