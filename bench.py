"""Headline queries on one machine; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from placewise.plans import registry
from placewise.session import local_session

HEADLINE = [
    "n3_weighted_centroid_summary",
    "n5_hybrid_predictor",
    "n7_temporal_split_summary",
    "c3_forward_asof_visit",
    "c4_nearby_accounts",
    "f1_f10_visit_reliability",
    "g1_g12_visit_integrity",
    "m6_territory_metrics",
    "o11_contact_verdict",
    "e18_e23_parsed_addresses",
    "e1_e8_normalised_addresses",
    "i1_i2_heuristic_scores",
    "j8_calibration_report",
    "k11_outcome_reliability",
    "k13_visit_clusters",
    "l8_l10_location_merge",
    "k14_k17_evidence_predictions",
    "h14_batch_geocode",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.spark_queries()
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
