"""Bench: wall seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. ``build_features`` is the one-off cost of materialising the
feature table (windows, anomaly cut, encoding); every other query reads that
table, the way a deployment would serve the dashboard views from a curated table.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harborline.plans import features as FP  # noqa: E402
from harborline.plans.registry import queries  # noqa: E402
from harborline.session import local_session  # noqa: E402

HEADLINE = [
    "port_stats", "monthly_trend", "route_stats", "kpi_overview", "anomaly_lift", "waiting_time_box",
    "daily_series", "weekly_series", "corr_matrix", "top_correlations", "route_heatmap", "describe_features",
    "hist_delay_rates", "signal_rolls", "chronological_index", "lp_scenarios", "top_risk_shipments",
    "classification_metrics", "roc_auc", "business_impact", "explain_contributions", "reroute_advice",
    "route_prompts", "parse_analysis", "quality_profile", "stream_checkpoint_8h",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16)
    qs = queries()
    times: dict[str, float] = {}
    t = time.time()
    FP.load_features(spark, sf_dir)
    times["build_features"] = round(time.time() - t, 3)
    for name in HEADLINE:
        t = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_wall_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": cpus, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
