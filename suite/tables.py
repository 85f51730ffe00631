"""Domain tables derived from the driver's star-schema tables.

One text per table serves both engines (double constants are cast, integer
arithmetic on keys gives every value), so that checks start from equal input.
Geometry, projections and all operators are then done by the library in Spark
and spelled out as plain arithmetic in the reference SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landsieve.functions import geometry as G
from landsieve.functions.projection import add_utm, utm_point
from landsieve.operators.spatial import polygon_columns
from landsieve.session import spread

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


def d(v: float) -> str:
    return f"cast({v!r} as double)"


def lon(k: str, mul: int = 7919, mod: int = 100003) -> str:
    return f"({d(-120.2)} + {d(2.58)} * ((({k}) * {mul}) % {mod} / {d(float(mod))}))"


def lat(k: str, mul: int = 104729, mod: int = 99991) -> str:
    return f"({d(34.79)} + {d(1.02)} * ((({k}) * {mul} + 7) % {mod} / {d(float(mod))}))"


def letters(k: str) -> str:
    return f"translate(cast({k} as string), '0123456789', 'ABCDEFGHIJ')"


VIEWS: dict[str, str] = {}

VIEWS["parcels"] = f"""
SELECT k + 1 AS id,
  concat(case when k % 13 = 0 then '=' else ' ' end, cast(k % 1000 as string), '-', cast(k % 97 as string),
         case when k % 11 = 0 then ' x,"y"' else ' ' end) AS apn,
  x, y, x - h AS x0, y - h AS y0, x + h AS x1, y + h AS y1,
  case when k % 17 = 3 then null else (k * 31) % 6400 / {d(10.0)} end AS acres,
  case when k % 7 = 1 then null else (k * 17) % 300 / {d(10.0)} end AS mean_slope_pct,
  case when k % 3 = 0 then (k * 19) % 300 / {d(10.0)} else null end AS mean_slope_pct_final,
  case when k % 19 = 5 then null else {d(4.5)} + (k * 13) % 200 / {d(100.0)} end AS ghi,
  case when k % 23 = 7 then null else cast((k * 101) % 25000 as double) end AS dist_tx_m,
  cast((k * 211) % 25000 as double) AS dist_sub_m,
  case k % 5 when 0 then {d(66.0)} when 1 then {d(115.0)} when 3 then {d(230.0)} when 4 then {d(500.0)} else null end AS nearest_sub_kv,
  case when k % 4 = 1 then null else cast((k * 37) % 2500 as double) end AS poi_competition_mw,
  case when k % 4 = 1 then null else k % 9 end AS poi_competition_n,
  case when k % 29 = 4 then null else k % 6 = 0 end AS sfha_flag,
  case k % 8 when 0 then 'A' when 1 then 'M-1' when 2 then 'E' when 3 then 'R-1' when 4 then 'C-2' when 5 then 'OTHER' when 6 then null else 'P' end AS zoning_class,
  k % 31 = 0 AS excl_protected_area, k % 37 = 0 AS excl_open_water,
  case when k % 41 = 0 then null else k % 43 = 0 end AS excl_built_up,
  case when k % 2 = 0 then cast((k * 307) % 60000 as double) else null end AS eia_nearest_m
FROM (SELECT o_orderkey AS k, {lon('o_orderkey')} AS x, {lat('o_orderkey')} AS y, {d(0.0008)} * (1 + o_orderkey % 5) AS h FROM orders) b
"""

VIEWS["substations"] = f"""
SELECT k + 1 AS id, concat('SS-', cast(k as string)) AS source_id,
  concat('Pine', {letters('k - k % 8')}, case k % 8 when 1 then ' Creek Substation' when 3 then ' Hill Tap' when 5 then ' Creek' when 7 then ' Mesa JCT' when 2 then ' 230 kV' else ' Sub' end) AS name,
  x, y, case k % 6 when 0 then 66 when 1 then 115 when 2 then 230 when 3 then 500 when 4 then 0 else -999999 end AS raw_kv,
  case k % 6 when 0 then {d(66.0)} when 1 then {d(115.0)} when 2 then {d(230.0)} when 3 then {d(500.0)} else null end AS max_voltage_kv
FROM (SELECT s_suppkey AS k, {lon('s_suppkey', 15485863, 100019)} AS x, {lat('s_suppkey', 32452843, 99989)} AS y FROM supplier) b
"""

VIEWS["lines"] = f"""
SELECT k + 1 AS line_id, x AS ax, y AS ay, x + {d(0.02)} + {d(0.001)} * (k % 10) AS bx, y + {d(0.01)} AS by_,
  x + {d(0.03)} AS cx, y - {d(0.015)} * (1 + k % 2) AS cy, case k % 5 when 0 then 230 when 1 then 115 when 2 then 500 when 3 then -999999 else 0 end AS raw_kv
FROM (SELECT s_suppkey AS k, {lon('s_suppkey', 7907, 100043)} AS x, {lat('s_suppkey', 7901, 99971)} AS y FROM supplier) b
"""

VIEWS["zones"] = f"""
SELECT id, zone_code_raw, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM (
  SELECT cast(n_nationkey + 1 as bigint) AS id, concat(case n_nationkey % 5 when 0 then 'A' when 1 then 'm-1' when 2 then 'E(20)*' when 3 then 'MS 2 1/2' else '' end, '') AS zone_code_raw,
    {d(-120.2)} + {d(0.516)} * (n_nationkey % 5) AS x0, {d(34.79)} + {d(0.204)} * ((n_nationkey - n_nationkey % 5) / {d(5.0)}) AS y0, {d(0.516)} AS w, {d(0.204)} AS h FROM nation
  UNION ALL
  SELECT cast(100 + r_regionkey as bigint), 'R-1', {d(-120.1)} + {d(0.4)} * r_regionkey, {d(34.9)} + {d(0.05)} * r_regionkey, {d(0.9)}, {d(0.5)} FROM region
  UNION ALL
  SELECT 1000 + s_suppkey, case s_suppkey % 3 when 0 then 'NR(40)' when 1 then 'C-2' else null end,
    {lon('s_suppkey', 6133, 100069)}, {lat('s_suppkey', 6131, 99961)}, {d(0.03)} * (1 + s_suppkey % 4), {d(0.03)} FROM supplier) z
"""

VIEWS["floods"] = f"""
SELECT k + 1 AS id, x AS tx, y AS ty, {d(0.01)} * (1 + k % 8) AS w, {d(0.02)} AS h,
  case k % 8 when 0 then 'AE' when 1 then ' a ' when 2 then 'VE' when 3 then 'X' when 4 then 'AREA NOT INCLUDED' when 5 then 'D' when 6 then null else 'AO' end AS fld_zone,
  case k % 3 when 0 then 'T' when 1 then ' f' else null end AS sfha_tf
FROM (SELECT s_suppkey AS k, {lon('s_suppkey', 5003, 100103)} AS x, {lat('s_suppkey', 5009, 99929)} AS y FROM supplier) b
"""

VIEWS["overlays"] = f"""
SELECT k + 1 AS id, case k % 3 when 0 then 'protected_area' when 1 then 'open_water' else 'built_up' end AS kind,
  x AS x0, y AS y0, x + w AS x1, y + w AS y1
FROM (SELECT c_custkey AS k, {lon('c_custkey', 4001, 100109)} AS x, {lat('c_custkey', 4003, 99923)} AS y,
        {d(0.002)} * case when c_custkey % 100 = 7 then 60 else 1 + c_custkey % 4 end AS w FROM customer) b
"""

VIEWS["solar"] = f"""
SELECT p_partkey + 1 AS id, {lon('p_partkey', 3001, 100129)} AS lon, {lat('p_partkey', 3011, 99907)} AS lat,
  {d(4.5)} + (p_partkey * 17) % 2000 / {d(1000.0)} AS avg_ghi FROM part
"""

VIEWS["generators"] = f"""
SELECT s_suppkey + 1 AS id, {lon('s_suppkey', 2003, 100151)} AS x, {lat('s_suppkey', 2011, 99901)} AS y FROM supplier
"""

VIEWS["queue_raw"] = f"""
SELECT c_custkey AS queue_id, concat('Project ', cast(c_custkey as string)) AS project_name,
  case c_custkey % 4 when 0 then 'Solar' when 1 then 'Storage' when 2 then '' else null end AS generation_type,
  case c_custkey % 7 when 0 then 'Active' when 1 then 'Withdrawn' when 2 then 'Completed' when 3 then 'IN SERVICE since' when 4 then '' when 5 then null else 'Active' end AS status,
  case when c_custkey % 9 = 8 then 'n/a' else concat(cast(1 + c_custkey % 3 as string), ',', cast(100 + c_custkey % 900 as string), '.5 MW') end AS capacity_text,
  case c_custkey % 5 when 0 then 'Kern' when 1 then ' kern county' when 2 then 'Los Angeles, Kern' when 3 then 'Kernville' else 'Inyo' end AS county,
  case c_custkey % 10
    when 0 then concat('Pine', {letters('(c_custkey % 96) - (c_custkey % 96) % 8')}, ' 230 kV Substation')
    when 1 then concat('North Pine', {letters('(c_custkey % 96) - (c_custkey % 96) % 8')}, ' Station 66')
    when 2 then concat('pine', {letters('(c_custkey % 96) - (c_custkey % 96) % 8')}, '-Creek')
    when 3 then 'Creek' when 4 then 'Hill 115kV' when 5 then null when 6 then 'ZZ' when 7 then 'Mesa Tap'
    when 8 then concat('Pine', {letters('(c_custkey % 96) - (c_custkey % 96) % 8')}, ' Mesa East')
    else 'Substation 230' end AS poi_name,
  case when c_custkey % 12 = 0 then '230 kV' when c_custkey % 12 = 1 then '-999999' else null end AS volt_text
FROM customer
"""

VIEWS["requests"] = f"""
SELECT k AS request_id, case when k % 2 = 0 then 'utility_solar' else 'data_center' end AS use_case,
  x - w AS x0, y - w AS y0, x + w AS x1, y + w AS y1,
  case when k % 3 = 0 then {d(0.5)} else null end AS o_ghi, case when k % 3 = 0 then {d(0.1)} else null end AS o_competition,
  case when k % 4 = 0 then {d(0.0)} else null end AS t_min_acres, case when k % 4 = 1 then {d(25.0)} else null end AS t_max_slope_pct,
  case when k % 5 = 0 then false else null end AS t_exclude_sfha, case when k % 6 = 0 then true else null end AS t_optional,
  k % 7 = 0 AS own_codes, cast(5 + k % 6 as int) AS "limit", cast(k % 3 as int) AS "offset"
FROM (SELECT c_custkey AS k, {lon('c_custkey', 1009, 100153)} AS x, {lat('c_custkey', 1013, 99881)} AS y, {d(0.01)} * (1 + c_custkey % 5) AS w FROM customer) b
"""

VIEWS["usage"] = """
SELECT event_id, ts, concat('10.0.0.', cast(user_id as string)) AS client,
  case when event_type in ('view', 'click', 'signup') then 'text' else 'voice' end AS mode,
  case user_id % 4 when 0 then 'google:gemini-3.5-flash' when 1 then 'GEMINI-2.5-FLASH-lite' when 2 then 'gemini-x' else 'other' end AS model,
  cast(floor(value * 100) as bigint) AS t_in, cast(floor(value * 10) as bigint) AS t_out, cast(floor(value * 30) as bigint) AS t_cached
FROM events
"""

VIEWS["dem"] = f"""
SELECT (o_orderkey - o_orderkey % 150) / 150 AS row_, o_orderkey % 150 AS col_,
  case when o_orderkey % 997 = 500 then null else {d(3.0)} * (o_orderkey % 150) + (o_orderkey * 7) % 11 / {d(4.0)} end AS z FROM orders
"""

VIEWS["plots"] = f"""
SELECT k + 1 AS id, x AS x0, y AS y0, x + w AS x1, y + w AS y1
FROM (SELECT o_orderkey AS k, (o_orderkey * 7919) % 4400 + {d(0.5)} AS x, (o_orderkey * 104729) % 2900 + {d(0.25)} AS y, {d(7.0)} + o_orderkey % 60 AS w FROM orders) b
"""

VIEWS["rules_raw"] = """
SELECT p_partkey + 2 AS line,
  case when p_partkey % 50 = 49 then '  ' when p_partkey % 6 = 5 then 'A' else concat('Z', cast(p_partkey % 40 as string), case when p_partkey % 3 = 0 then ' ' else '' end) end AS zone_code,
  concat('Zone ', cast(p_partkey % 40 as string)) AS zone_name,
  case p_partkey % 5 when 0 then 'solar' when 1 then 'wind' when 2 then 'storage' when 3 then 'data_center' else 'mining' end AS use_case,
  case p_partkey % 7 when 0 then 'by_right' when 1 then 'conditional' when 2 then 'prohibited' when 3 then '' when 4 then 'prohibited' when 5 then 'maybe' else 'conditional' end AS permission,
  concat('b', cast(p_partkey as string)) AS basis
FROM part
"""

VIEWS["rules"] = """
SELECT zone_code, zone_name, use_case, permission, basis FROM (
  SELECT trim(zone_code) AS zone_code, zone_name, use_case, permission, basis, line,
    row_number() OVER (PARTITION BY trim(zone_code), use_case ORDER BY line) AS rn
  FROM rules_raw WHERE trim(zone_code) <> '' AND use_case <> 'mining' AND permission IN ('by_right', 'conditional', 'prohibited')) r
WHERE rn = 1
"""

VIEWS["zone_codes"] = """
SELECT DISTINCT concat('Z', cast(s_suppkey % 60 as string)) AS zone_code FROM supplier
"""

VIEWS["texts"] = f"""
SELECT c_custkey AS request_id, case c_custkey % 14
  when 0 then '  Kern   County, CA ' when 1 then 'score parcels near Mojave please' when 2 then 'Cal City'
  when 3 then concat('-119.', cast(c_custkey % 10 as string), ', 35.2, -118.9, 35.', cast(c_custkey % 7 as string))
  when 4 then '35.4 -119.2' when 5 then 'craft in nowhere' when 6 then 'near Lake Isabella or Taft'
  when 7 then '-119.02,35.37' when 8 then 'I-5 and CA-58' when 9 then 'ridge crest' when 10 then 'TAFT.'
  when 11 then '35.1, -119.5, 35.3, -119.1' when 12 then null else concat('lot ', cast(c_custkey as string), ' in Wasco') end AS text
FROM customer
"""

VIEWS["prices"] = f"""
SELECT o_custkey AS county, cast(1990 + o_orderkey % 30 as int) AS yr, concat(cast(1990 + o_orderkey % 30 as string), '-01-01') AS obs_date,
  case when o_orderkey % 9 = 0 then '.' when o_orderkey % 9 = 1 then '' when o_orderkey % 9 = 2 then null else cast(cast(floor(o_totalprice) as bigint) as string) end AS value_text,
  o_orderkey AS k
FROM orders
"""

VIEWS["medians"] = """
SELECT o_custkey AS county, cast(2000 + o_orderkey % 25 as int) AS yr, o_orderkey AS k,
  case when o_orderkey % 10 = 0 then '-666666666' when o_orderkey % 10 = 1 then 'null' else cast(cast(floor(o_totalprice) as bigint) as string) end AS value_text
FROM orders
"""

DEPS = {"rules": ["rules_raw"]}


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A derived table as a Spark DataFrame."""
    sql = re.sub(r'"(\w+)"', r"`\1`", VIEWS[name]) if name == "requests" else VIEWS[name]
    if name == "dem":
        sql = sql.replace(") / 150", ") div 150")
    used = {}
    for t in [*BASE, *DEPS.get(name, [])]:
        if re.search(rf"\b(FROM|JOIN) {t}\b", sql):
            used[t] = view(spark, sf, t) if t in VIEWS else spark.read.parquet(f"{sf}/{t}.parquet")
            if t not in VIEWS:
                used[t] = spread(used[t])
            sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **used)


def oracle(query: str) -> str:
    """Prefix a DuckDB query with the derived tables it names."""
    def body(name):
        return VIEWS[name].replace(") / 150", ") // 150") if name == "dem" else VIEWS[name]

    wanted: list[str] = []

    def need(text):
        for name in VIEWS:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                for dep in DEPS.get(name, []):
                    need(f" {dep} ")
                if name not in wanted:
                    wanted.append(name)

    need(query)
    q = query.strip()
    if not wanted:
        return q
    head = ", ".join(f"{n} AS ({body(n).strip()})" for n in wanted)
    if q.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {q[15:]}"
    return f"WITH {head}, {q[5:]}" if q[:5].upper() == "WITH " else f"WITH {head} {q}"


# --- geometry of the derived tables, built by the library ------------------------

def box_layer(df: DataFrame) -> DataFrame:
    return polygon_columns(df.withColumn("parts", G.box_polygon(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))))


def parcels_geo(spark: SparkSession, sf: str) -> DataFrame:
    """Parcels with their box polygon; bbox straight from the four numbers."""
    p = view(spark, sf, "parcels")
    return p.withColumn("bbox", F.struct(F.col("x0").alias("xmin"), F.col("y0").alias("ymin"),
                                         F.col("x1").alias("xmax"), F.col("y1").alias("ymax")))


def parcel_points(spark: SparkSession, sf: str) -> DataFrame:
    """Parcel centres in metres."""
    p = view(spark, sf, "parcels").select("id", F.col("x").alias("clon"), F.col("y").alias("clat"))
    return add_utm(p, "clon", "clat")


def metric(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return add_utm(df, x, y)


def flood_geo(df: DataFrame) -> DataFrame:
    x, y = F.col("tx"), F.col("ty")
    ring = F.array(G.point(x, y), G.point(x + F.col("w"), y), G.point(x, y + F.col("h")), G.point(x, y))
    return polygon_columns(df.withColumn("parts", G.polygon(ring)))


def line_geo(df: DataFrame, metres: bool = True) -> DataFrame:
    def pt(x, y):
        return utm_point(F.col(x), F.col(y)) if metres else G.point(F.col(x), F.col(y))

    return df.withColumn("line", F.array(pt("ax", "ay"), pt("bx", "by_"), pt("cx", "cy")))


# L-shaped study boundary used by the clipping queries.
L_SHAPE = [(-119.9, 34.9), (-118.1, 34.9), (-118.1, 35.2), (-119.0, 35.2), (-119.0, 35.6), (-119.9, 35.6), (-119.9, 34.9)]


def boundary(spark: SparkSession) -> DataFrame:
    ring = F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in L_SHAPE])
    return polygon_columns(spark.range(1).select(F.lit("06029").alias("geoid"), G.polygon(ring).alias("parts")))


# --- the same projection in SQL text ----------------------------------------------

def utm_sql(lon_: str, lat_: str) -> tuple[str, str]:
    """UTM zone 11N easting and northing as SQL arithmetic (Krueger series)."""
    a, f = 6378137.0, 1 / 298.257222101
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * 0.9996
    al = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
          61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    c = 2 * n**0.5 / (1 + n)
    s = f"sin(radians({lat_}))"
    t = f"sinh(atanh({s}) - {d(c)} * atanh({d(c)} * {s}))"
    dl = f"radians({lon_} - {d(-117.0)})"
    xi, eta = f"atan2({t}, cos({dl}))", f"atanh(sin({dl}) / sqrt(1 + ({t}) * ({t})))"
    e, nn = eta, xi
    for j, k in enumerate(al, 1):
        e += f" + {d(k)} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})"
        nn += f" + {d(k)} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})"
    return f"({d(500000.0)} + {d(big)} * ({e}))", f"({d(big)} * ({nn}))"
