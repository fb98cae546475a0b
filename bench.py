"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "p13_primitive_ladder", "j4_page_relation_counts", "a3_relation_label_counts", "j5_containment_and_text_edges", "j8_smallest_parent", "j11_remaining_share",
    "j13_detection_layer_match", "j23_text_overlap", "g1_detection_acceptance", "g2_confidence_order", "g6_connected_components", "g11_replay_plan",
    "q4_ownership_report", "a2_words_to_lines", "a4_color_tokens", "a15_batch_summary", "j1_project_cards", "snk1_export_manifest", "w5_rows_by_centre", "w7_vertical_bands",
    "r3_tile_maps", "st1_job_outcomes", "st3_activity_sessions",
]


def main() -> None:
    from boxloom.queries import QUERIES
    from boxloom.session import build

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build("bench", cpus)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
