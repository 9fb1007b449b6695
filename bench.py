"""Headline timings: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "complete_season_rows", "checklist_filter", "season_split", "dedupe_keep_first", "encounter_rate", "hotspot_entry",
    "dense_target_vector", "butterfly_targets", "merge_targets_weighted", "duplicate_groups", "season_reconcile",
    "nearest_hotspot", "cluster_5km", "cluster_split", "range_membership", "correct_targets", "bbox_intersect_join",
    "sample_all_rasters", "extract_patch", "interpolate_nan", "image_channel_stds", "normalize", "resize_bilinear",
    "metric_suite", "topk_adaptive", "topk_curve", "mean_encounter_baseline", "median_mosaic", "incremental_ingest",
]


def main() -> None:
    from fieldmark import session
    from fieldmark.plans import registered

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    available = registered.queries()
    only = sys.argv[1:]
    names = list(available) if only == ["all"] else (only or HEADLINE)
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(2):  # the first run also pays for code generation
            start = time.time()
            available[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.time() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": Path(folder).name.removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
