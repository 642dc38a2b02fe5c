"""What the plans have to look like for data that does not fit one machine."""

import re

import pytest
from helpers import SMALL, dicts
from pyspark.sql import functions as F, types as T

from trunkwatch.operators import alerts, forecast, latest, listing, quality, stats
from trunkwatch.plans.catalog import QUERIES
from trunkwatch.plans.imports import laid_out, write_laid_out
from trunkwatch.sources.bridge import view
from trunkwatch.streaming import imports as import_streams

# These run jobs while they are built, see the tests of imports, streams and the model.
ACTIONS = {"train_model", "model_accuracy", "score_defects", "feature_importance", "training_alerts",
           "import_objects", "import_diagnostics", "import_log", "run_alerts", "alert_log", "stream_import",
           "accuracy_check", "score_check", "importance_check", "training_alert_check", "import_and_train",
           "stream_defect_alerts", "read_all_marks", "filter_date_range", "workbook_folder_ingest", "scan_trunklines", "scan_objects", "scan_diagnostics", "csv_charset_fallback"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The tables as stored files, so that filters can reach the scan."""
    root = str(tmp_path_factory.mktemp("stored"))
    for name in ("objects", "diagnostics"):
        laid_out(view(spark, SMALL, name), name).drop(listing.DATE_PART).write.parquet(f"{root}/{name}")
    return {name: spark.read.parquet(f"{root}/{name}") for name in ("objects", "diagnostics")}


def test_a_range_of_dates_reads_its_years(spark, tmp_path):
    rows = view(spark, SMALL, "diagnostics")
    odd = rows.limit(6).withColumn("date", F.element_at(F.array(*map(F.lit, ["1997-13-45", "199", "", "1998", "x", None])),
                                                        (F.monotonically_increasing_id() % 6 + 1).cast("int")))
    rows = rows.unionByName(odd)
    write_laid_out(rows, "diagnostics", f"{tmp_path}/d")
    by_year = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField(listing.DATE_PART, T.StringType())])).parquet(f"{tmp_path}/d")
    for bounds in (("1997-01-01", "1998-12-31"), ("1997-06", None), (None, "1993-05-05"), ("", "1996"), (None, None), ("1997-13", "1998")):
        found, plain = listing.date_range(by_year, *bounds), listing.date_range(rows, *bounds)
        assert found.columns == rows.columns
        assert sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect()))
    found = listing.date_range(by_year, "1997-01-01", "1998-12-31")
    assert re.search(r"PartitionFilters: \[.*date_part#\d+ >= 1997", plan(found))
    found.collect()
    scan = found._jdf.queryExecution().executedPlan().toString()
    years = {f.split("date_part=")[1][:4] for f in by_year.inputFiles()}
    read = {f.split("date_part=")[1][:4] for f in listing.date_range(by_year, "1997-01-01", "1998-12-31").select("diag_id")
            .select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert len(years) > 6 and read <= {"1997", "1998", "none"} and "PartitionFilters: []" not in scan


@pytest.mark.parametrize("key", sorted(set(QUERIES) - ACTIONS))
def test_no_cross_joins_and_no_python_rows(spark, no_broadcast, key):
    text = plan(QUERIES[key](spark, SMALL))
    assert not re.search("CartesianProduct|NestedLoopJoin|BatchEvalPython|ArrowEvalPython", text)
    if key != "workbook_folder_ingest":
        assert "InPandas" not in text


def test_trend_takes_one_shuffle_and_hashes(spark, stored):
    text = plan(forecast.depth_trend(stored["diagnostics"]))
    assert text.count("Exchange hashpartitioning(object_id") == 1 and text.count("Exchange") == 1
    assert "SortAggregate" not in text and "Window" not in text
    assert "partial_regr_slope" in text and "partial_max_by" in text


def test_line_forecast_reads_diagnostics_once(spark, stored):
    lines = view(spark, SMALL, "pipelines")
    text = plan(forecast.trunkline_forecast(lines, stored["objects"], stored["diagnostics"], "2001-08-01"))
    assert len(re.findall(r"FileScan parquet \[.*?diag_id", text)) == 1


def test_latest_cuts_before_the_shuffle(stored):
    text = plan(latest.latest_per_object(stored["diagnostics"]))
    assert re.search(r"Exchange hashpartitioning\(object_id.*\n.*partial_max", text) and "Window" not in text


def test_newest_is_cut_before_the_shuffle_and_reads_once(spark, stored):
    text = plan(listing.newest(stored["diagnostics"], 1000))
    assert re.search(r"Exchange hashpartitioning\(_group.*\n.*WindowGroupLimit.*Partial", text)
    assert text.count("FileScan parquet") == 1


def test_map_points_read_what_they_show_and_only_their_line(stored):
    text = plan(latest.map_points(stored["diagnostics"], stored["objects"], pipeline_id="MT-07"))
    scan = next(x for x in text.splitlines() if "FileScan" in x and "diag_id" in x)
    read = re.search(r"ReadSchema: struct<(.*?)>", scan).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {
        "diag_id", "object_id", "method", "date", "defect_found", "defect_description", "quality_grade", "ml_label"}
    assert text.index("LeftSemi") > text.rindex("newest")


def test_read_all_marks_read_events_once_and_have_no_task_for_all(spark):
    events = view(spark, SMALL, "alert_events")
    folded = plan(alerts._timeline(events))
    assert folded.count("FileScan") == plan(events).count("FileScan")
    text = plan(alerts.read_all_marks(events))
    # from the written timeline: once for the rows and once for a row per partition
    assert text.count("FileScan") == 2
    single = [i for i, line in enumerate(text.splitlines()) if "SinglePartition" in line]
    assert len(single) == 1 and "HashAggregate(keys=[part" in text.splitlines()[single[0] + 1]


def test_validation_reads_each_table_once(spark, stored, no_broadcast):
    checked = quality.validate_diagnostics(stored["diagnostics"], stored["objects"])
    text = plan(checked)
    assert len(re.findall(r"FileScan parquet \[.*?diag_id", text)) == 1 and text.count("FileScan") == 2
    assert plan(quality.validate_objects(stored["objects"])).count("FileScan") == 1
    started = plan(quality.validate_at_startup(stored["objects"], stored["diagnostics"]))
    assert started.count("FileScan") == 3  # objects are read to be judged, and to be referred to
    assert re.search(r"Exchange hashpartitioning\(kind.*\n.*partial_count", text)


def test_critical_objects_are_cut_before_the_shuffle(spark, stored):
    text = plan(forecast.critical_objects(stored["objects"], stored["diagnostics"]))
    assert re.search(r"Exchange hashpartitioning\(pipeline_id.*\n.*WindowGroupLimit.*Partial", text)


def test_filters_and_columns_reach_the_scan(stored):
    rows = listing.filter_diagnostics(stored["diagnostics"], stored["objects"], object_id=7, method="UZK",
                                      date_from="1996-01-01", date_to="1997-01-01")
    text = plan(rows.select("diag_id"))
    assert all(f in text for f in ("EqualTo(object_id,7)", "EqualTo(method,UZK)",
                                   "GreaterThanOrEqual(date,1996-01-01)", "LessThanOrEqual(date,1997-01-01)"))
    assert "ReadSchema: struct<diag_id:bigint,object_id:bigint,method:string,date:string>" in text
    summary = plan(stats.report_summary(stored["diagnostics"]))
    assert "ReadSchema: struct<defect_found:boolean,ml_label:string>" in summary


def test_line_filter_after_a_left_join_becomes_a_semi_join(stored):
    assert "LeftSemi" in plan(listing.on_line(stored["diagnostics"], stored["objects"], "MT-01"))


# --- one object with a third of all rows ---------------------------------------------


@pytest.fixture
def tiny_skew_limits(spark, no_broadcast):
    """Limits scaled down to test data: the join must split its hot partition."""
    limits = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8KB",
              "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
              "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
              "spark.sql.adaptive.coalescePartitions.enabled": "false",
              "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def skewed(spark, stored, tmp_path_factory):
    """A third of 60,000 diagnostics on object 5, spread over many map tasks."""
    path = str(tmp_path_factory.mktemp("skewed") / "rows")
    pattern = stored["diagnostics"].where("defect_found").limit(500).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(119))))
    (pattern.withColumn("diag_id", F.col("diag_id") * 1000 + F.col("k"))
     .withColumn("object_id", F.when(F.col("k") % 3 == 0, F.lit(5)).otherwise(F.pmod(F.xxhash64("diag_id"), F.lit(150))))
     .drop("k").repartition(16).write.parquet(path))
    return spark.read.parquet(path)


JOINS = {
    "enrich": lambda d, o: listing.with_object(d, o, "object_name", "pipeline_id"),
    "orphans": lambda d, o: listing.orphans(d, o.where("object_id <> 5")),
    "days": lambda d, o: forecast.days_since_first_defect(d),
    "alerts": lambda d, o: alerts.defect_alerts(d, o),
    "judged": lambda d, o: import_streams.judged(d, o),
    "outcome": lambda d, o: import_streams.outcome(d.drop("diag_id").withColumnRenamed("object_id", "diag_id")
                                                   .withColumn("reasons", F.array().cast("array<string>"))),
    "located": lambda d, o: latest.locate_on_trunkline(
        d.select(F.col("diag_id").alias("object_id"), F.col("object_id").cast("string").alias("pipeline_id"),
                 F.col("param1").alias("lat"), F.col("param2").alias("lon")).distinct()),
}


@pytest.mark.parametrize("name", JOINS)
def test_hot_object_is_split(spark, stored, skewed, tiny_skew_limits, name):
    df = JOINS[name](skewed, stored["objects"])
    rows = df.collect()
    assert "skew=true" in plan(df)
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        plain = JOINS[name](skewed, stored["objects"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    assert sorted(map(repr, rows)) == sorted(map(repr, plain))


def test_hot_object_forecast_equals_pandas(stored, skewed):
    got = {r["object_id"]: r for r in dicts(forecast.depth_trend(skewed))}
    frame = skewed.select("diag_id", "object_id", "date", "param1").toPandas()
    import numpy as np
    import pandas as pd
    for object_id in (5, 6, 7):
        own = frame[frame["object_id"] == object_id].copy()
        own["x"] = (pd.to_datetime(own["date"]) - pd.to_datetime(own["date"]).min()).dt.days
        slope, intercept = np.polyfit(own["x"], own["param1"], 1)
        last = own.sort_values(["date", "diag_id"]).iloc[-1]
        assert got[object_id]["defect_count"] == len(own)
        assert got[object_id]["slope"] == pytest.approx(slope, abs=6e-5)
        assert got[object_id]["predicted_depth"] == pytest.approx(intercept + slope * (last["x"] + 365), abs=6e-3)
        assert got[object_id]["current_depth"] == last["param1"]
