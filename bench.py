"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from landsieve.session import build_session  # noqa: E402
from suite.catalog import QUERIES  # noqa: E402

HEADLINE = ["score_topk", "batch_score", "breakdown", "nearest_substation", "nearest_ghi", "nearest_line_distance",
            "radius_join", "zoning_at_point", "flood_flag", "exclusion_overlay_flags", "queue_summary", "poi_match_left",
            "zonal_mean", "tile_thin", "spend_ledger_stream"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    runs = dict.fromkeys(HEADLINE)
    QUERIES["score_topk"](spark, sf).count()  # start-up is not part of any query
    for key in runs:
        started = time.time()
        QUERIES[key](spark, sf).write.format("noop").mode("overwrite").save()
        runs[key] = round(time.time() - started, 3)
    requests = spark.read.parquet(f"{sf}/customer.parquet").count()
    parcels = spark.read.parquet(f"{sf}/orders.parquet").count()
    print(json.dumps({
        "metric": "land_suitability_headline_total", "value": round(sum(runs.values()), 3), "unit": "sec",
        "queries": runs, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
        "requests_per_sec": round(requests / runs["batch_score"], 1),
        "parcels_per_sec": {k: round(parcels / runs[k], 1) for k in (
            "nearest_substation", "nearest_ghi", "nearest_line_distance", "zoning_at_point", "flood_flag")},
    }))


if __name__ == "__main__":
    main()
