"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from alertweave import build_session, catalog
from alertweave.catalog import registry

HEADLINE = (
    "held_out_rule_triage",
    "w1_strict_past_context",
    "w2_strict_past_candidates",
    "w4_arrival_context",
    "w5_companion_context",
    "w6_short_long_context",
    "w11_ratio_split",
    "j1_label_by_interval",
    "f2_reveal_labels",
    "f6_duplicate_safe_split",
    "a10_rule_identifiability",
    "a13_association_cells",
    "a14_association_score",
    "a15_retrieval_audit",
    "m11_probability_metrics",
    "t6_association_abs",
    "t8_anchored_association",
    "m9_strict_metrics",
    "o4_select_baseline_matched",
    "b1_scenario_bootstrap_ci",
    "g5_next_event_confidence",
    "g7_density_cluster",
    "g11_triage_nearest",
    "a16_sequence_scan",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"}
    )
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds = {}
    for name in names:
        registry.forget()  # every query pays for what it reads
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
