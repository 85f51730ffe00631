"""Cleaning, scoring, queue, economics and usage against known values."""

import pytest
from pyspark.sql import functions as F

from landsieve import constants as K
from landsieve.functions import cleaning as C
from landsieve.functions import geometry as G
from landsieve.operators import economics as EC
from landsieve.operators import queue as QU
from landsieve.operators import results as RS
from landsieve.operators import rules as RU
from landsieve.operators import scoring as SC
from landsieve.operators import usage as U
from landsieve.operators.spatial import polygon_columns
from landsieve.sources import writers as W

PARCELS = [  # id, acres, slope, ghi, tx, sub, kv, poi_mw, sfha, zone, lng
    (11, 95.0, 4.5, 6.2, 1500.0, 900.0, 230.0, None, False, "A", -118.64),
    (12, 34.0, 11.0, 5.5, 7000.0, 6500.0, None, None, False, "C-2", -118.63),
    (13, 410.0, 27.0, 6.1, 450.0, 250.0, 345.0, 640.0, False, "M-1", -118.62),
    (14, 12.0, 2.5, 6.3, 1100.0, 800.0, 66.0, None, False, "A", -118.61),
    (15, 150.0, 1.5, 6.4, 700.0, 400.0, 230.0, None, True, "A", -118.60),
    (16, 66.0, 6.0, 6.0, 2600.0, 1700.0, 115.0, None, False, "R-1", -118.59),
    (17, 48.0, None, 5.9, 3300.0, 2400.0, None, None, False, None, -118.58),
]


@pytest.fixture(scope="module")
def parcels(spark):
    df = spark.createDataFrame(PARCELS, "id long, acres double, mean_slope_pct double, ghi double, dist_tx_m double, dist_sub_m double, nearest_sub_kv double, poi_competition_mw double, sfha_flag boolean, zoning_class string, lng double")
    for k in K.EXCLUSION_KINDS:
        df = df.withColumn(f"excl_{k}", F.lit(None).cast("boolean"))
    df = df.withColumn("apn", F.concat(F.lit("=A"), "id")).withColumn("mean_slope_pct_final", F.lit(None).cast("double")).withColumn(
        "poi_competition_n", F.lit(None).cast("long")).withColumn("eia_nearest_m", F.lit(None).cast("double"))
    return polygon_columns(df.withColumn("parts", G.box_polygon(F.col("lng"), F.lit(35.3), F.col("lng") + 0.005, F.lit(35.305)))).cache()


def ids(df):
    return [r.id for r in df.select("id").collect()]


def test_survivors(parcels):
    solar = ids(SC.score_topk(parcels, "utility_solar", prohibited=["R-1"]))
    assert set(solar) == {11, 12, 17} and solar[0] == 11
    assert set(ids(SC.score_topk(parcels, "data_center", prohibited=["R-1"]))) == {11, 12, 14, 17}
    assert set(ids(SC.score_topk(parcels, "utility_solar", prohibited=["A"]))) == {12, 16, 17}
    assert 14 in ids(SC.score_topk(parcels, "utility_solar", thresholds={"min_acres": 0}, prohibited=["R-1"]))
    assert ids(SC.score_topk(parcels, "utility_solar", prohibited=["R-1"], limit=1, offset=1)) == solar[1:2]


def test_candidates(parcels):
    assert len(ids(SC.candidates(parcels, (-118.65, 35.28, -118.55, 35.33)))) == 7
    assert ids(SC.candidates(parcels, (-117.5, 36.5, -117.4, 36.6))) == []
    plan = SC.candidates(parcels, (-118.65, 35.28, -118.55, 35.33))._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_batch_rejects_and_ranks_deep_pages(spark, parcels):
    """Bad requests get no page; pages past a thousand rows are ranked like others."""
    many = spark.range(3000).select(F.lit(1).alias("request_id"), F.col("id"), (F.pmod(F.col("id") * 7919, F.lit(3001)) * 1.0).alias("score_raw"),
                                    F.lit(500).alias("limit"), F.lit(1500).alias("offset"))
    got = SC.best_of_each(many, 2000).orderBy("rank").collect()
    order = sorted(range(3000), key=lambda i: (-(i * 7919 % 3001), i))
    assert [r.id for r in got] == order[:2000] and [r["rank"] for r in got] == list(range(1, 2001))
    rows = [(1, "utility_solar", None, None), (2, "wind", None, None), (3, "utility_solar", {"nope": 1.0}, None),
            (4, "utility_solar", {"ghi": -1.0}, None), (5, "utility_solar", dict.fromkeys(K.FACTORS, 0.0), None),
            (6, "utility_solar", None, -5.0), (7, "data_center", {"ghi": float("nan")}, None), (8, None, None, None)]
    reqs = spark.createDataFrame([(*r, None, None, None, ["R-1"], 10, 0) for r in rows], (
        "request_id int, use_case string, weights map<string,double>, t_min_acres double, t_max_slope_pct double, "
        "t_exclude_sfha boolean, t_optional boolean, prohibited array<string>, limit int, offset int"))
    reqs = polygon_columns(reqs.withColumn("parts", G.polygon(F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in (
        (-118.65, 35.2), (-118.622, 35.2), (-118.65, 35.4), (-118.65, 35.2))]))))
    full = SC.request_columns(reqs).drop("weights", "parts")
    assert {r.request_id: r.reject_reason for r in full.collect()} == {
        1: None, 2: "unknown use case", 3: "unknown weight", 4: "bad weight", 5: "weights sum to zero", 6: "bad threshold",
        7: "bad weight", 8: "unknown use case"}
    page = SC.batch_score(parcels, full, 0.1).collect()
    assert [(r.request_id, r.id) for r in page] == [(1, 11)]  # 12 lies in the triangle's box but not in it


def test_breakdown_sums_to_score(parcels):
    for r in SC.explain(parcels, "utility_solar", prohibited=["R-1"]).collect():
        assert abs(sum(f.contribution for f in r.factors) - r.score_raw) < 0.2
        assert [f.contribution for f in r.factors] == sorted((f.contribution for f in r.factors), reverse=True)
    seven = SC.explain(parcels.filter("id = 17"), "utility_solar").withColumn("why", SC.why_this_rank(F.col("factors"))).first()
    slope = next(f for f in seven.factors if f.key == "slope")
    assert (slope.known, slope.normalized, slope.raw) == (False, 0.5, None)
    assert "terrain slope" in seven.why and not seven.excluded


def test_weights():
    w = SC.resolve_weights("utility_solar", {"ghi": 0, "competition": 0.25})
    assert "ghi" not in w and abs(sum(w.values()) - 1) < 1e-12
    for bad in ({"nope": 1}, {"ghi": -1}, {"ghi": float("inf")}, dict.fromkeys(K.FACTORS, 0)):
        with pytest.raises(ValueError):
            SC.resolve_weights("utility_solar", bad)
    with pytest.raises(ValueError):
        SC.resolve_thresholds("utility_solar", {"min_acres": -1})


def test_results_csv(spark, parcels, tmp_path):
    page = SC.score_topk(parcels, "utility_solar", prohibited=["R-1"]).withColumn("rank", F.col("id").cast("int"))
    W.write_results_csv(page, str(tmp_path / "csv"))
    part = next((tmp_path / "csv").glob("part-*"))
    text = part.read_bytes().decode("utf-8")
    assert text.startswith("﻿rank,id,apn,") and text.count("\r\n") == 4 and "'=A11" in text and ",95,A,false," in text


def test_compare_and_page(parcels):
    assert {r.attribute for r in RS.compare_set(parcels, [11, 12], ["zoning_class", "acres"]).collect()} == {"zoning_class", "acres"}
    assert ids(RS.result_page(parcels, "slope", 0, 3)) == [15, 14, 11]


def test_cleaning(spark):
    z = spark.createDataFrame([("E(20)*",), ("NR(40)",), (" ",), ("A*",), ("MS 2 1/2",), ("m-1",), (None,)], "c string")
    assert [r[0] for r in z.select(C.zone_code_norm(F.col("c"))).collect()] == ["E", "NR", "OTHER", "A", "MS", "M-1", "OTHER"]
    n = spark.createDataFrame([("Whirlwind230",), ("Whirlwind 230 kV Substation",), ("A-B Tap Jct",)], "c string")
    assert [r[0] for r in n.select(C.station_name_norm(F.col("c"))).collect()] == ["WHIRLWIND", "WHIRLWIND", "A B"]
    assert C.pick_column(["oid", "Apn"], ["APN"], "apn") == "Apn"
    with pytest.raises(ValueError):
        C.pick_column(["x"], ["APN"], "apn")


def test_competition(spark):
    st = spark.createDataFrame([(7, "ELM FLAT", 115.0, -118.4, 35.2), (8, "COLDWATER", None, -118.44, 35.2), (9, "TWO FORKS", 66.0, -118.6, 35.2)], "id long, name string, max_voltage_kv double, x double, y double")
    from landsieve.operators.enrich import with_metric_point
    st = with_metric_point(st, "x", "y")
    q = spark.createDataFrame([("u", "Elm Flat 115kV", 40.0), ("v", "Coldwater", 25.0), ("w", "Two Forks Switchyard", 70.0)], "queue_id string, poi_name string, capacity_mw double")
    q = q.withColumn("is_active", F.lit(True)).withColumn("source_voltage_kv", F.lit(None).cast("double"))
    got = {r.poi_name: (r.n_at_poi, r.mw_at_poi, r.n_within_radius, r.mw_within_radius) for r in QU.poi_competition(QU.match_queue(q, st), st).collect()}
    assert got == {"ELM FLAT": (1, 40, 2, 65), "COLDWATER": (1, 25, 2, 65), "TWO FORKS": (1, 70, 1, 70)}


def test_rules(spark):
    rules = spark.createDataFrame([("M-1", "Light", "data_center", "by_right", "b")], "zone_code string, zone_name string, use_case string, permission string, basis string")
    zones = spark.createDataFrame([("ZZ",), ("M-1",)], "zone_code string")
    filled = RU.rules_gap_fill(zones, rules).collect()
    assert len(filled) == 8 and sum(r.basis == K.ZONING_DEFAULT_BASIS for r in filled) == 7
    assert RU.rules_gaps(zones, rules).count() == 7


def test_costs(spark):
    rows = [("text", "gemini-3.5-flash", '{"input_tokens":1000000,"output_tokens":1000000}', 10.5),
            ("text", "gemini-3.5-flash", '{"input_tokens":1000000,"cache_read_tokens":1000000}', 0.15),
            ("text", "unknown", '{"request_tokens":1000000}', 1.5), ("text", "x", None, 0.0),
            ("voice", "", '{"input_token_details":{"audio_tokens":1000000},"output_token_details":{"audio_tokens":1000000}}', 99.0),
            ("voice", "", "junk", 0.0), ("voice", "", '{"input_tokens":1000000}', 35.0)]
    df = spark.createDataFrame(rows, "mode string, model string, usage string, want double")
    for r in U.price_events(df).collect():
        assert abs(r.cost_usd - r.want) < 1e-9, r
    assert U.effective_cap(None) == 3.0 and U.effective_cap(-1) == 0.0


def test_economics(spark):
    body = '{"observations":[{"date":"2023-01-01","value":"309.89"},{"date":"2024-01-01","value":"324.07"},{"date":"2022-01-01","value":"."}]}'
    y = EC.price_yoy(EC.price_series_parse(spark.createDataFrame([(1, body)], "county int, body string"))).first()
    assert (y.hpi_index, y.as_of, round(y.yoy_pct, 1)) == (324.07, "2024-01-01", 4.6)
    m = spark.createDataFrame([(1, 2023, '[["h"],["310600","Kern"]]'), (2, 2023, '[["h"],["-666666666"]]'), (3, 2023, "junk"), (3, 2022, '[["h"],["5"]]')], "county int, year int, body string")
    assert {r.county: (r.median_home_value_usd, r.acs_vintage) for r in EC.median_value_parse(m).collect()} == {1: (310600, "2023 ACS 5-year"), 3: (5, "2022 ACS 5-year")}
