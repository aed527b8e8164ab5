"""Wall time of the headline queries. Prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from geoledger.session import build_session  # noqa: E402
from geoledger.workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "evidence_rules", "event_rules", "registry_rule_counts", "snapshot_property_rules", "evidence_matrix", "evidence_bundles",
    "period_changes_month", "search_points", "point_cards", "point_updates", "merged_events", "review_queue", "page_titles",
    "manifest_upsert", "latest_change_per_id", "point_index", "feature_overlaps", "gained_area_by_status", "change_area_by_transition",
    "snapshot_diff",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("geoledger-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["search_points"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # not timed: starts the engine
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(scale.group(1)) if scale else None}))


if __name__ == "__main__":
    main()
