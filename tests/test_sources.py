"""Readers that must not lose rows, repair of odd polygons, exact money."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from landsieve import session
from landsieve.functions import geometry as G
from landsieve.operators import repair as RP
from landsieve.operators import usage as U
from landsieve.sources import readers as S


def page(ids, **more):
    feats = [{"type": "Feature", "properties": {"ID": str(i)}, "geometry": {"type": "Point", "coordinates": [i, i]}} for i in ids]
    return json.dumps({"type": "FeatureCollection", "features": feats} | more)


def pages(spark, bodies):
    return spark.createDataFrame(bodies, "page int, body string")


def ids(df):
    return sorted(int(r[0]) for r in df.select(F.col("properties")["ID"]).collect())


def test_pages_end_only_where_nothing_more_is_promised(spark):
    plain = pages(spark, [(0, page(range(3))), (1, page(range(3, 6))), (2, page([6]))])
    assert ids(S.read_feature_pages(plain, 3)) == list(range(7))
    capped = pages(spark, [(0, page([0, 1], exceededTransferLimit=True)),
                           (1, page([2, 3], properties={"exceededTransferLimit": True})), (2, page([4]))])
    assert ids(S.read_feature_pages(capped, 10)) == [0, 1, 2, 3, 4]
    empty_end = pages(spark, [(0, page(range(3))), (1, page([]))])
    assert ids(S.read_feature_pages(empty_end, 3)) == [0, 1, 2]


@pytest.mark.parametrize("bodies, expected", [
    ([(0, page(range(3))), (1, "{broken"), (2, page([6]))], None),
    ([(0, page(range(3))), (1, None), (2, page([6]))], None),
    ([(0, page(range(3))), (1, json.dumps({"error": {"code": 500}}))], None),
    ([(0, page(range(3))), (2, page([6]))], None),
    ([(0, page(range(3))), (0, page([6]))], None),
    ([(0, page([1])), (1, page([6]))], None),
    ([(0, page(range(3)))], None),
    ([(0, page(range(3))), (1, page([6]))], 9),
], ids=["unreadable", "null", "error", "gap", "repeated", "beyond the end", "more promised", "total"])
def test_page_faults_fail_the_read(spark, bodies, expected):
    with pytest.raises(S.SourceError):
        S.read_feature_pages(pages(spark, bodies), 3, expected)


def test_fallback_passes_over_failing_sources(spark, tmp_path):
    good = pages(spark, [(0, page([1]))])
    bad = pages(spark, [(0, "{broken")])
    label, df = S.source_fallback([
        ("missing", lambda: spark.read.parquet(str(tmp_path / "none"))), ("broken", lambda: S.read_feature_pages(bad, 3)),
        ("empty", good.filter("page > 5")), ("fine", lambda: S.read_feature_pages(good, 3))])
    assert label == "fine" and ids(df) == [1]
    with pytest.raises(S.SourceError, match="no rows"):
        S.source_fallback([("empty", good.filter("page > 5"))])


def test_feature_lines_have_places_and_columns(spark, tmp_path):
    lines = [json.loads(page([i]))["features"][0] for i in range(5)]
    lines[0]["properties"] |= {"kind": "a", "Owner": "x"}
    lines[1]["properties"] |= {"OWNER": "y"}
    spark.createDataFrame([(json.dumps(x),) for x in lines], "value string").write.text(str(tmp_path / "f"))
    feats = S.read_feature_lines(spark, str(tmp_path / "f"))
    assert set(feats.columns) == set(S.read_features(spark, str(tmp_path / "f")).columns)
    wide = S.property_columns(feats)
    assert feats.select("source_file", "pos").distinct().count() == 5
    rows = {r["ID"]: r for r in wide.collect()}
    assert rows["0"]["property_kind"] == "a" and rows["0"]["kind"] == "Point"
    assert (rows["0"]["OWNER"], rows["1"]["OWNER"]) == ("x", "y")
    spark.createDataFrame([("nonsense",)], "value string").write.text(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="not a feature"):
        S.read_feature_lines(spark, str(tmp_path / "bad")).collect()


def ring(*xy):
    return F.array(*[G.point(F.lit(float(x)), F.lit(float(y))) for x, y in xy])


def test_repair_of_bow_tie_with_holes(spark):
    bow = ring((0, 0), (4, 4), (4, 0), (0, 4), (0, 0))
    in_right = ring((3.2, 1.8), (3.6, 1.8), (3.6, 2.2), (3.2, 2.2), (3.2, 1.8))
    outside = ring((9, 9), (10, 9), (10, 10), (9, 10), (9, 9))
    parts = F.array(F.struct(F.array(bow, in_right, outside).alias("rings")))
    both = spark.range(1).select("id", parts.alias("parts")).unionByName(
        spark.range(5, 6).select("id", F.array(F.struct(F.array(bow).alias("rings"))).alias("parts")))
    got = {r.id: r for r in RP.geometry_repair(both).select("id", "repair", G.area(F.col("parts")).alias("a"), "parts").collect()}
    assert {r.repair for r in got.values()} == {"repaired"}
    assert got[5].a == pytest.approx(8.0) and got[0].a == pytest.approx(8.0 - 0.16)
    assert sorted(len(p.rings) for p in got[0].parts) == [1, 2]


@pytest.mark.parametrize("cap", ["2.0", "2.1", "3.0", "3.9"])
def test_cap_is_crossed_at_the_exact_event(spark, cap):
    usage = '{"output_tokens": 11111}'  # 0.099999 USD each, so binary sums drift
    events = spark.range(1, 61).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 7000).alias("ts"), F.lit("c").alias("client"),
        F.lit("text").alias("mode"), F.lit("gemini-3.5-flash").alias("model"), F.lit(usage).alias("usage"))
    each, want = Decimal(11111 * 9000), 1
    while each * want < Decimal(cap) * 10**9:
        want += 1
    replayed = events.unionByName(events.filter("event_id < 5"))
    got = U.cap_crossings(U.price_events(replayed), float(cap)).collect()
    assert [r.event_id for r in got] == [want]
    assert U.spend_ledger(U.price_events(replayed)).first().spent_nano == 60 * each


def test_work_folder_needs_a_shared_one_off_this_machine(spark):
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master = "spark://head:7077"

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.work_dir(Session)
