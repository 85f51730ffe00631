"""A cross-section of the registered queries against their reference SQL, plus stream behaviour."""

import pytest
from pyspark.sql import functions as F

from landsieve.streaming import usage as ST
from suite.catalog import ORACLE, QUERIES
from suite.check import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ["score_topk", "exclusion_flags", "batch_score", "queue_summary", "rules_gap_fill", "place_resolve", "price_yoy",
          "poi_match_left", "radius_join", "nearest_substation", "zoning_at_point", "flood_flag", "raster_slope", "raster_resample",
          "zonal_mean", "tile_thin", "request_dedupe", "surrogate_id", "cap_alert_batch"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", SAMPLE)
def test_query(spark, con, key):
    status, _, note = compare(spark, con, SF, key, QUERIES[key], ORACLE[key])
    assert status == "ok", note


def test_registry():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 150


def test_replayed_events_and_single_alert(spark, tmp_path):
    """A repeated event is charged once; an alert is raised in one batch only."""
    src = tmp_path / "in"
    schema = "event_id long, ts timestamp, client string, mode string, model string, usage string"
    usage = '{"input_tokens":1000000}'

    def batch(n, ids):
        spark.createDataFrame([(i, "a", "text", "gemini-3.5-flash", usage) for i in ids], "event_id long, client string, mode string, model string, usage string").select(
            "event_id", F.timestamp_seconds(F.col("event_id")).alias("ts"), "client", "mode", "model", "usage").coalesce(1).write.parquet(f"{src}/b{n}")

    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(src))
    batch(1, [1, 2])
    batch(2, [2, 3])
    ST.write_priced(read(), str(tmp_path / "priced"), str(tmp_path / "cp1")).awaitTermination()
    assert sorted(r.event_id for r in ST.read_priced(spark, str(tmp_path / "priced")).collect()) == [1, 2, 3]
    ST.write_alerts(read(), str(tmp_path / "alerts"), str(tmp_path / "cp2"), 3.0).awaitTermination()
    batch(3, [4])
    ST.write_alerts(read(), str(tmp_path / "alerts"), str(tmp_path / "cp2"), 3.0).awaitTermination()
    assert ST.read_alerts(spark, str(tmp_path / "alerts")).count() == 1
    ST.write_ledger(read(), str(tmp_path / "ledger"), str(tmp_path / "cp3")).awaitTermination()
    assert ST.read_ledger(spark, str(tmp_path / "ledger")).first().spent_usd == pytest.approx(6.0)
