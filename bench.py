"""Wall time of the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from trunkwatch.plans.catalog import QUERIES  # noqa: E402
from trunkwatch.session import session  # noqa: E402

HEADLINES = [
    # interactive reads
    "dashboard_summary", "trunkline_stats", "yearly_trend", "method_distribution", "top_defect_objects",
    "list_diagnostics", "object_history", "latest_inspection_per_object", "map_points", "enrich_left",
    "report_summary", "report_high_risk_top20",
    # forecasts
    "depth_trend", "object_forecast", "top_risks", "critical_objects", "trunkline_forecast",
    # quality, imports, alerts
    "validate_diagnostics", "startup_validation", "import_diagnostics", "workbook_folder_ingest",
    "defect_alerts", "current_alerts", "read_all_marks",
    # streams and the classifier
    "stream_import", "stream_defect_alerts", "defect_features", "train_model", "score_defects",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("OFF")

    def run(key: str) -> float:
        started = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    run("dashboard_summary")  # starts the JVM's engines
    times = {key: run(key) for key in HEADLINES}
    spark.stop()
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
