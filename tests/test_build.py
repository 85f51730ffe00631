"""End-to-end build on tiny hand-made layers."""

import json

import pytest
from pyspark.sql import functions as F

from landsieve.functions import geometry as G
from landsieve.operators import raster as R
from landsieve.plans import build
from landsieve.sources import readers as S


def square(x0, y0, x1, y1):
    return {"type": "Polygon", "coordinates": [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]}


def features(spark, tmp, name, items):
    """A layer from line-delimited features."""
    lines = [json.dumps({"type": "Feature", "properties": p, "geometry": g}) for p, g in items]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(tmp / name))
    return S.read_feature_lines(spark, str(tmp / name))


def point(x, y):
    return {"type": "Point", "coordinates": [x, y]}


def line(*xy):
    return {"type": "LineString", "coordinates": [list(p) for p in xy]}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    tmp = tmp_path_factory.mktemp("src")
    fe = lambda name, items: features(spark, tmp, name, items)
    queue = spark.createDataFrame([
        ("G1", "First", "Solar", "60", "Kern", "CA", "Active", "Oak Mesa 115 kV Substation"),
        ("G2", "Second", "Storage", "2,040 MW", "Fresno, Kern", "CA", "Active", "OAK MESA"),
        ("G3", "Third", "Solar", "33", "Kern County", "CA", "Withdrawn", "Delta Sub"),
        ("G4", "Fourth", "Wind", "8", "Kernville", "CA", "Active", "Oak Mesa"),
        ("G5", "Fifth", "", "n/a", "Kern", "CA", None, "Unknown Place"),
    ], "`Queue ID` string, `Project Name` string, `Generation Type` string, `Capacity (MW)` string, County string, State string, Status string, `Interconnection Location` string")
    ghi = spark.createDataFrame([("-119.26", "35.235", "5.1"), ("-118.56", "35.33", "6.3"), ("-116.4", "35.3", "8"), ("-119.0", "35.1", None)],
                                "lon string, lat string, ghi string")
    knot = [[-118.9, 35.05], [-118.82, 35.13], [-118.82, 35.05], [-118.9, 35.13], [-118.9, 35.05]]
    src = {
        "county": fe("county", [({"GEOID": "06029", "STATEFP": "06", "COUNTYFP": "029", "NAME": "Kern"}, square(-119.8, 34.95, -118.1, 35.55)),
                                ({"GEOID": "06019", "STATEFP": "06", "COUNTYFP": "019", "NAME": "Fresno"}, square(-120, 36, -119, 37))]),
        "parcels": fe("parcels", [({"APN": " 44-10 07 "}, square(-119.3, 35.2, -119.22, 35.27)), ({"APN": "5502-31"}, square(-118.6, 35.3, -118.52, 35.36)),
                                  ({"APN": "knot 9"}, {"type": "Polygon", "coordinates": [knot]})]),
        "transmission": fe("lines", [({"ID": "N-1", "VOLTAGE": 115}, line((-119.35, 35.0), (-119.35, 35.4))),
                                     ({"ID": "N-2", "VOLTAGE": -999999}, line((-118.4, 35.1), (-117.6, 35.1))), ({"ID": "N-3", "VOLTAGE": 345}, line((-117.6, 35.1), (-117.2, 35.1)))]),
        "substations": fe("subs", [({"ID": "301", "NAME": "Oak Mesa", "MAX_VOLT": 115, "MIN_VOLT": 12}, point(-119.27, 35.23)),
                                   ({"ID": "302", "NAME": "DELTA", "MAX_VOLT": 345, "MIN_VOLT": 0}, point(-118.55, 35.34)), ({"ID": "303", "NAME": "FAR", "MAX_VOLT": 1}, point(-116, 35.2))]),
        "flood": fe("flood", [({"FLD_AR_ID": "Z1", "FLD_ZONE": "AE", "SFHA_TF": "T"}, square(-119.25, 35.24, -119.24, 35.25)),
                              ({"FLD_AR_ID": "Z2", "FLD_ZONE": "AH", "SFHA_TF": None}, square(-118.3, 35.0, -117.9, 35.1)),
                              ({"FLD_AR_ID": "Z3", "FLD_ZONE": "X", "SFHA_TF": "F"}, square(-118.58, 35.31, -118.54, 35.35)),
                              ({"FLD_AR_ID": "Z4", "FLD_ZONE": "AREA NOT INCLUDED", "SFHA_TF": None}, square(-118.58, 35.31, -118.54, 35.35))]),
        "zoning": fe("zoning", [({"Zn_Cd1": "A"}, square(-119.8, 34.95, -118.1, 35.55)), ({"Zn_Cd1": "PL(5)*"}, square(-119.31, 35.19, -119.21, 35.28)),
                                ({"Zn_Cd1": " "}, square(-119.3, 35.2, -119.29, 35.21))]),
        "general_plan": fe("gp", [({"GP_DESIG": "3.2", "LU_DESC": "y"}, square(-119.2, 35, -118.4, 35.5))]),
        "specific_plans": fe("sp", [({"SP_NAME_1": "Rim"}, square(-119.2, 35, -118.4, 35.5))]),
        "queue": queue, "ghi": ghi,
        "exclusions": {"protected_area": fe("prot", [({"OBJECTID": 5, "Unit_Nm": "Ridge"}, square(-118.57, 35.32, -118.2, 35.5))])},
    }
    cells = spark.range(60 * 140).select(F.floor(F.col("id") / 140).alias("row"), F.pmod("id", F.lit(140)).alias("col")).withColumn("z", F.col("col") * 60.0)
    grid = R.Grid(270000.0, 3860000.0, 1000.0, 1000.0, 60, 140)
    src["dem"] = (cells, grid, grid, None)
    return build.run(spark, src, str(tmp_path_factory.mktemp("out")))


def test_layer_counts(tables):
    want = {"county_boundary": 1, "parcels": 3, "transmission_lines": 2, "substations": 2, "flood_sfha": 2, "zoning": 3,
            "general_plan": 1, "specific_plans": 1, "caiso_queue": 4, "poi_competition": 1, "ghi_grid": 2, "exclusions": 1}
    assert {k: tables[k].count() for k in want} == want


def test_cleaning_and_clipping(tables):
    assert {r.apn_norm for r in tables["parcels"].collect()} == {"441007", "550231", "KNOT9"}
    ends = {r.source_id: (r.voltage_kv, r.pieces[-1][-1].x) for r in tables["transmission_lines"].collect()}
    assert ends == {"N-1": (115.0, -119.35), "N-2": (None, -118.1)}
    flood = {r.source_id: r.bbox.xmax for r in tables["flood_sfha"].collect()}
    assert flood == {"Z1": -119.24, "Z2": -118.1}
    assert sorted(r.zone_code for r in tables["zoning"].collect()) == ["A", "OTHER", "PL"]


def test_queue(tables):
    q = {r.queue_id: r for r in tables["caiso_queue"].collect()}
    assert q["G1"].poi_voltage_kv == 115 and q["G2"].capacity_mw == 2040 and q["G3"].is_active is False
    assert q["G5"].matched_substation_id is None and q["G5"].is_active is False
    c = tables["poi_competition"].first()
    assert (c.n_at_poi, c.mw_at_poi, c.n_within_radius, c.mw_within_radius) == (2, 2100.0, 2, 2100.0)
    total = tables["caiso_queue_summary"].filter("category = 'total'").first()
    assert (total.n_projects, total.active_n_projects, total.total_mw) == (4, 2, 2133.0)


def test_enriched(tables):
    p = {r.apn_norm: r for r in tables["parcels"].collect()}
    a, b = p["441007"], p["550231"]
    assert (a.nearest_sub_kv, b.nearest_sub_kv) == (115.0, 345.0)
    assert 0 < a.dist_sub_m < 5000 and 0 < b.dist_sub_m < 5000
    assert (a.ghi, b.ghi) == (5.1, 6.3)
    assert (a.sfha_flag, b.sfha_flag) == (True, False)
    assert (a.zoning_class, b.zoning_class) == ("PL", "A")
    assert (a.poi_competition_mw, a.poi_competition_n, b.poi_competition_mw) == (2100.0, 2, None)
    assert (a.excl_protected_area, b.excl_protected_area) == (False, True)
    assert abs(a.mean_slope_pct - 6.0) < 1e-9
    assert abs(a.clon + 119.26) < 1e-3 and p["KNOT9"].area_sqm > 0


def test_bad_county_fails(spark, tmp_path):
    f = features(spark, tmp_path, "c", [({"GEOID": "06019", "STATEFP": "06", "COUNTYFP": "019", "NAME": "Fresno"}, square(0, 0, 1, 1))])
    with pytest.raises(S.SourceError):
        build.build_county(f)


def test_parts_valid(tables):
    bad = tables["parcels"].filter(G.geometry_problem(F.col("geometry")).isNotNull()).count()
    assert bad == 0
