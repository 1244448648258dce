"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from framewise.plans import QUERIES  # noqa: E402
from framewise.session import local_session  # noqa: E402

HEADLINE = [
    "q2_library_search", "q1_local_align", "j12_similarity_cross_join", "w1_change_score", "w2_detect_boundaries",
    "w3_merge_false_cuts", "w4_merge_edge_fragments", "w7_timeline_layout", "w10_people_rank", "a1_robust_stats",
    "a6_shot_summary", "a8_classify_motion", "a13_segment_error", "a17_quality_flags", "a18_group_summary",
    "a20_truth_scorecard", "a22_height_scorecard", "a31_weighted_checklist", "j1_best_overlap_join",
    "j2_point_in_interval_join", "j18_rule_join", "j20_grid_search_argmin", "j23_within_radius_join",
    "s2_reference_shots", "f1_validate_reference_shots", "f2_validate_cinematic_plan", "e8_motion_end_state",
    "e26_motion_shift_geometry", "h1_component_pose", "h3_infer_roles", "q5_place_subjects", "st1_stream_boundaries",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n] or HEADLINE
    spark = local_session("bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
