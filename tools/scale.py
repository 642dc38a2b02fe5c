"""Times of the heavier queries on many rows with a hot object, a hot date and a bulk hour.

    python tools/scale.py FOLDER [ROWS] [CPUS]

Rows are made by Spark in FOLDER once and used again by later runs. A third of
the diagnostics is on one object, a third of them on one date, and half of the
alert events fall into one hour.
"""

from __future__ import annotations

import json
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from trunkwatch import schema as s  # noqa: E402
from trunkwatch.operators import alerts, forecast, latest, listing, quality  # noqa: E402
from trunkwatch.plans import imports  # noqa: E402
from trunkwatch.session import session  # noqa: E402
from trunkwatch.sources.tables import complete  # noqa: E402


def pick(values: list[str], seed: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(values))) + 1).cast("int"))


def make(spark: SparkSession, folder: str, n: int) -> None:
    hashed = lambda seed, size: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(size))
    objects = spark.range(n // 20 + 1).select(
        F.col("id").alias("object_id"), F.concat(F.lit("object "), "id").alias("object_name"), pick(s.OBJECT_TYPES, "t").alias("object_type"),
        F.concat(F.lit("MT-"), hashed("line", 25)).alias("pipeline_id"), (hashed("lat", 900) / 10).alias("lat"), (hashed("lon", 900) / 10).alias("lon"))
    diagnostics = spark.range(n).select(
        F.col("id").alias("diag_id"), F.when(hashed("hot", 3) == 0, F.lit(5)).otherwise(hashed("object", n // 20 + 1)).cast("long").alias("object_id"),
        pick(s.METHODS_AT_STARTUP, "m").alias("method"),
        F.when(hashed("date", 3) == 0, F.lit("2024-05-05")).otherwise(F.date_add(F.lit("2015-01-01"), hashed("day", 3000).cast("int")).cast("string")).alias("date"),
        (hashed("d", 10) < 6).alias("defect_found"), pick(s.QUALITY_GRADES, "g").alias("quality_grade"),
        (hashed("p", 600) / 10).alias("param1"), pick(s.RISK_LABELS, "l").alias("ml_label"))
    instant = F.timestamp_micros(F.when(hashed("bulk", 2) == 0, F.lit(0)).otherwise(hashed("h", 9000) * 3_600_000_000)
                                 + F.lit(1_700_000_000_000_000) + hashed("us", 3_600_000_000))
    events = spark.range(n // 3).select(
        F.when(F.col("id") % 1000 > 0, F.concat(F.lit("a"), "id")).alias("alert_id"),
        F.when(F.col("id") % 1000 > 0, "created").otherwise("read_all").alias("action"), instant.alias("event_at"), F.lit("info").alias("type"))
    for name, df, kinds in [("objects", objects, s.OBJECTS), ("diagnostics", diagnostics, s.DIAGNOSTICS), ("events", events, s.ALERT_EVENTS)]:
        complete(df, kinds).write.mode("ignore").parquet(f"{folder}/{name}")


def main() -> None:
    folder, n = sys.argv[1], int((sys.argv[2:3] or ["30000000"])[0])
    cpus = (sys.argv[3:4] or ["8"])[0]
    spark = session("scale", f"local[{cpus}]", **{"spark.ui.enabled": "false", "spark.driver.memory": "16g",
                                                  "spark.sql.shuffle.partitions": str(4 * int(cpus)), "spark.checkpoint.dir": f"{folder}/shared"})
    spark.sparkContext.setLogLevel("OFF")
    make(spark, folder, n)
    read = {name: spark.read.parquet(f"{folder}/{name}") for name in ("objects", "diagnostics", "events")}
    o, d, e = read["objects"], read["diagnostics"], read["events"]

    def timed(build) -> float:
        started = time.perf_counter()
        df = build()
        if isinstance(df, DataFrame):
            df.write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 1)

    def import_all() -> None:
        path = f"{folder}/shared/in-{time.time():.0f}"
        d.write.option("header", True).csv(f"{path}/csv")
        started = time.perf_counter()
        result = imports.import_diagnostics(spark, f"{path}/csv", f"{path}/store")
        times["import alone"] = round(time.perf_counter() - started, 1)
        assert result.success, result.errors

    times: dict[str, float] = {}
    for name, build in {
        "inspection profile": lambda: forecast.inspection_profile(d),
        "newest 1,000": lambda: listing.newest(d, 1000), "newest 100,000": lambda: listing.newest(d, 100_000),
        "map points": lambda: latest.map_points(d, o), "map points of a line": lambda: latest.map_points(d, o, pipeline_id="MT-7"),
        "latest per object": lambda: latest.latest_per_object(d), "read-all marks": lambda: alerts.read_all_marks(e),
        "validation": lambda: quality.validate_diagnostics(d, o), "CSV written and imported": import_all,
    }.items():
        times[name] = timed(build)
    print(json.dumps({"rows": n, "cpus": int(cpus), "seconds": times}))


if __name__ == "__main__":
    main()
