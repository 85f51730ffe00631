"""Requests with few profiles: the pages of all pairs, from few rows for each request however densely parcels lie."""

import pytest
from pyspark.sql import functions as F

from landsieve import constants as K
from landsieve.functions import geometry as G
from landsieve.operators import scoring as SC
from landsieve.operators.spatial import polygon_columns


@pytest.fixture(scope="module")
def land(spark):
    k = F.col("id")
    h = F.when(k % 1999 == 3, F.lit(0.3)).otherwise(F.lit(0.002) * (1 + k % 4))
    x, y = (k * 7919) % 10007 / 10007.0, (k * 104729) % 10009 / 10009.0
    df = spark.range(12000).select("id", x.alias("x"), y.alias("y"), h.alias("h")).withColumns({
        "acres": ((k * 31) % 640).cast("double"), "mean_slope_pct": (k * 17) % 30 / 1.0, "ghi": 4.5 + (k * 13) % 20 / 10.0,
        "dist_tx_m": ((k * 101) % 25000).cast("double"), "dist_sub_m": ((k * 211) % 25000).cast("double"),
        "nearest_sub_kv": F.when(k % 5 > 0, F.lit(230.0)), "poi_competition_mw": ((k * 37) % 2500).cast("double"),
        "sfha_flag": k % 6 == 0, "zoning_class": F.when(k % 8 == 3, "R-1").otherwise("A")})
    for kind in K.EXCLUSION_KINDS:
        df = df.withColumn(f"excl_{kind}", k % 31 == 0)
    return polygon_columns(df.withColumn("parts", G.box_polygon(x - h, y - h, x + h, y + h))).drop("parts").cache()


@pytest.fixture(scope="module")
def requests(spark):
    rows = [(i, "utility_solar" if i % 2 else "data_center", None, None, None, None, i % 3 == 0, ["R-1"], 4 + i % 5, i % 3,
             0.05 + (i * 37 % 80) / 100, 0.05 + (i * 53 % 80) / 100, 0.03 + 0.02 * (i % 8)) for i in range(60)]
    reqs = spark.createDataFrame(rows, (
        "request_id int, use_case string, weights map<string,double>, t_min_acres double, t_max_slope_pct double, "
        "t_exclude_sfha boolean, t_optional boolean, prohibited array<string>, limit int, offset int, x double, y double, w double"))
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    ring = F.array(G.point(x, y), G.point(x + w, y), G.point(x, y + w), G.point(x, y))
    parts = F.when(F.col("request_id") % 4 == 0, G.polygon(ring)).otherwise(G.box_polygon(x, y, x + w, y + w))
    return SC.request_columns(polygon_columns(reqs.withColumn("parts", parts))).drop("weights", "parts", "x", "y", "w")


@pytest.mark.parametrize("exact", [True, False])
def test_shared_scores_give_the_pages_of_all_pairs(land, requests, monkeypatch, exact):
    deep, seen = F.col("offset") + F.col("limit"), []
    best = SC.best_of_each
    monkeypatch.setattr(SC, "SHARED", 0.02, raising=False)
    monkeypatch.setattr(SC, "best_of_each", lambda scored, *more: best((seen.append(scored.count()), scored)[1], *more))
    got = {(r.request_id, r["rank"]): (r.id, r.score_raw) for r in SC.batch_score(land, requests, 0.1, exact).collect()}
    monkeypatch.undo()
    pairs = land.alias("p").join(requests.select(*[F.col(c).alias(f"r_{c}") for c in requests.columns]), G.bbox_overlaps(F.col("bbox"), F.col("r_bbox")))
    th = {"min_acres": F.col("r_min_acres"), "max_slope_pct": F.col("r_max_slope_pct"), "exclude_sfha": F.col("r_exclude_sfha"),
          "apply_optional_exclusions": F.col("r_apply_optional")}
    pairs = SC.exclusion_flags(pairs, th, F.col("r_prohibited")).filter(~SC.any_exclusion())
    if exact:
        pairs = pairs.filter(G.polygons_intersect(F.col("edges"), F.col("anchors"), F.col("r_edges"), F.col("r_anchors")))
    total = sum((F.col(f"r_w_{k}") * SC.factor_norm(k) for k in K.FACTORS), F.lit(0.0))
    pairs = pairs.select(F.col("r_request_id").alias("request_id"), "id", (F.lit(100.0) * total).alias("score_raw"),
                         F.col("r_limit").alias("limit"), F.col("r_offset").alias("offset")).cache()
    want = {(r.request_id, r["rank"]): (r.id, r.score_raw) for r in best(pairs, 20).filter((F.col("rank") > F.col("offset")) & (F.col("rank") <= deep)).collect()}
    assert got.keys() == want.keys() and len(want) > 300
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)
    assert seen[0] < pairs.count() / 3, (seen, pairs.count())
