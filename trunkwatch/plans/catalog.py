"""Every query by name, over the bridge views of a test-data folder.

Each entry reads its tables as a whole. Queries of readers, imports, logs and
streams first write what they read from those same tables.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, functions as F, types as T

from trunkwatch import schema as s
from trunkwatch.functions import banding, criticality, text
from trunkwatch.functions.cleaning import clean_non_finite, inspection_year
from trunkwatch.operators import alerts, forecast, latest, listing, model, quality, stats
from trunkwatch.plans import imports, report
from trunkwatch.session import work_folder
from trunkwatch.sources import store, tables, workbooks
from trunkwatch.sources.bridge import view
from trunkwatch.streaming import alerts as alert_streams, imports as import_streams

AS_OF = "2001-08-01"  # the day of the latest inspection in the test tables
LINE = "MT-07"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(*inputs: str, key: str | None = None):
    """Registers a function of DataFrames; its inputs are views by name."""
    def register(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(*[view(spark, sf_dir, name) for name in inputs])
        QUERIES[key or build.__name__] = run
        return build
    return register


def add(key: str, build: Callable[..., DataFrame], *inputs: str, **fixed) -> None:
    query(*inputs, key=key)(lambda *frames: build(*frames, **fixed))


# --- sources and sinks ---------------------------------------------------------

def _as_csv(df: DataFrame) -> DataFrameWriter:
    return df.write.option("header", True).option("escape", '"')


def _dump_csv(df: DataFrame, purpose: str) -> str:
    folder = work_folder(df.sparkSession, purpose)
    _as_csv(df).csv(folder)
    return folder


def _scan(reader: Callable[..., DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: reader(df.sparkSession, _dump_csv(df, "scan"))


add("scan_trunklines", _scan(tables.read_pipelines), "pipelines")
add("scan_objects", _scan(tables.read_objects), "objects")
add("scan_diagnostics", _scan(tables.read_diagnostics), "diagnostics")


@query("objects")
def csv_charset_fallback(objects: DataFrame) -> DataFrame:
    """The object table in UTF-8, in cp1251 and, with names that only it can hold, in Latin-1, read as one folder."""
    folder = work_folder(objects.sparkSession, "charsets")
    _as_csv(objects).csv(f"{folder}/utf8")
    as_bytes = objects.select([
        F.translate(c, tables.AS_CP1251, tables.AS_LATIN1).alias(c) if t == "string" else F.col(c)
        for c, t in objects.dtypes])
    _as_csv(as_bytes).option("encoding", "ISO-8859-1").csv(f"{folder}/cp1251")
    western = objects.withColumn("object_name", F.concat("object_name", F.lit("\x98é"))).withColumn("material", F.lit("acier"))
    _as_csv(western).option("encoding", "ISO-8859-1").csv(f"{folder}/latin1")
    return tables.read_objects(objects.sparkSession, f"{folder}/*")


@query("objects")
def clean_headers(objects: DataFrame) -> DataFrame:
    untidy = objects.toDF(*[f" \ufeff{c}\u200b " for c in objects.columns])
    return tables.clean_headers(untidy)


def _sheet(frame: pd.DataFrame) -> bytes:
    """A one-sheet workbook with inline texts."""
    def row(values) -> str:
        cells = "".join(f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>' for v in values)
        return f"<row>{cells}</row>"

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    doc = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pkg = "http://schemas.openxmlformats.org/package/2006/relationships"
    rows = row(frame.columns) + "".join(row(v) for v in frame.itertuples(index=False))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{doc}"><sheets>'
                      '<sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pkg}">'
                      '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml",
                      f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


def _dump_workbooks(df: DataFrame) -> str:
    """A folder of workbooks, one per Arrow batch, written by tasks; one that is run again replaces its own."""
    folder = work_folder(df.sparkSession, "workbooks")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path)
        for n, batch in enumerate(batches):
            name = f"{TaskContext.get().partitionId():05}-{n:05}.xlsx"
            with files.open_output_stream(f"{path}/{name}") as out:
                out.write(_sheet(batch))
            yield pd.DataFrame({"name": [name]})

    df.mapInPandas(pack, "name string").write.format("noop").mode("overwrite").save()
    return folder


@query("objects")
def workbook_folder_ingest(objects: DataFrame) -> DataFrame:
    """The object table as a folder of workbooks, read as an import reads it."""
    folder = _dump_workbooks(objects)
    parsed = workbooks.read_workbooks(objects.sparkSession, folder, s.OBJECTS)
    return tables.complete(tables.conform(parsed, s.OBJECTS), s.OBJECTS)


@query("objects")
def import_preview(objects: DataFrame) -> DataFrame:
    return tables.preview(objects.orderBy("object_id"))


def _import_two(objects: DataFrame, diagnostics: DataFrame) -> str:
    """A store with objects and then diagnostics imported from CSV."""
    spark = objects.sparkSession
    root = work_folder(spark, "store")
    for table, df in [("objects", objects), ("diagnostics", diagnostics)]:
        _as_csv(df).csv(f"{root}/drop/{table}.csv")
        imports.import_table(spark, f"{root}/drop/{table}.csv", root, table)
    return root


@query("objects")
def import_objects(objects: DataFrame) -> DataFrame:
    spark = objects.sparkSession
    root = work_folder(spark, "store")
    imports.import_objects(spark, _dump_csv(objects, "drop"), root)
    return store.current(spark, root, "objects")


@query("objects", "diagnostics")
def import_diagnostics(objects: DataFrame, diagnostics: DataFrame) -> DataFrame:
    root = _import_two(objects, diagnostics)
    return store.current(objects.sparkSession, root, "diagnostics")


@query("objects", "diagnostics")
def import_and_train(objects: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Diagnostics imported and the classifier fitted anew on what came into force."""
    spark = objects.sparkSession
    root = work_folder(spark, "store")
    _as_csv(objects).csv(f"{root}/drop/objects.csv")
    _as_csv(diagnostics).csv(f"{root}/drop/diagnostics.csv")
    imports.import_objects(spark, f"{root}/drop/objects.csv", root)
    result, fit = imports.import_and_train(spark, f"{root}/drop/diagnostics.csv", root)
    stored = store.current(spark, root, "diagnostics").agg(F.count("*").alias("n_stored"))
    return stored.select(F.lit(result.status).alias("status"), F.lit(result.rows_imported).cast("long").alias("rows_imported"),
                         "n_stored", F.lit(fit.is_trained).alias("is_trained"))


@query("objects", "diagnostics_dirty")
def import_log(objects: DataFrame, dirty: DataFrame) -> DataFrame:
    """Log of a good run, a rejected one and one without a file."""
    spark = objects.sparkSession
    root = _import_two(objects, dirty)
    imports.import_objects(spark, f"{root}/drop/missing.csv", root)
    return store.import_log(spark, root).select(
        "table_name", "file", "status", "rows",
        F.coalesce(F.size("errors"), F.lit(0)).alias("n_errors"))


@query("objects", "diagnostics")
def alert_log(objects: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Created events of all defects, appended to a log and read back."""
    path = work_folder(objects.sparkSession, "alerts")
    found = alerts.defect_alerts(diagnostics, objects)
    events = alerts.created_events(found, F.lit(AS_OF).cast("timestamp"),
                                   "pipeline_id", "object_id", "risk_level", "category")
    store.append_events(events, path, s.ALERT_EVENTS)
    logged = store.read_events(objects.sparkSession, path, s.ALERT_EVENTS)
    return logged.select("alert_id", "action", "message", "type",
                         F.date_format("event_at", "yyyy-MM-dd HH:mm:ss").alias("event_at"),
                         F.col("metadata")["risk_level"].alias("risk_level"),
                         F.col("metadata")["object_id"].alias("object_id"))


# --- data quality ----------------------------------------------------------------

@query("objects_dirty", "diagnostics_dirty")
def dq_duplicate_keys(objects: DataFrame, diagnostics: DataFrame) -> DataFrame:
    def one(df: DataFrame, key: str) -> DataFrame:
        count = quality.count_repeats(df, key).withColumnRenamed(f"duplicate_{key}", "n_bad")
        both = count.unionByName(quality.first_repeats(df, key), allowMissingColumns=True)
        return both.agg(F.lit(f"duplicate_{key}").alias("rule"), F.max("n_bad").alias("n_bad"),
                        F.max("examples").alias("examples"))

    return one(objects, "object_id").unionByName(one(diagnostics, "diag_id"))


add("dq_object_types", quality.offending_values, "objects_dirty",
    column="object_type", allowed=s.OBJECT_TYPES)
add("dq_quality_grades", quality.offending_values, "diagnostics_dirty",
    column="quality_grade", allowed=s.QUALITY_GRADES)
add("dq_risk_labels", quality.offending_values, "diagnostics_dirty",
    column="ml_label", allowed=s.RISK_LABELS)


@query("diagnostics_dirty")
def dq_methods(diagnostics: DataFrame) -> DataFrame:
    """Unknown methods by the list used at import and the shorter one used at start-up."""
    at_import = quality.offending_values(diagnostics, "method", s.METHODS_AT_IMPORT)
    at_startup = quality.offending_values(diagnostics, "method", s.METHODS_AT_STARTUP)
    return (at_import.withColumn("stage", F.lit("import"))
            .unionByName(at_startup.withColumn("stage", F.lit("startup"))))


def _rules(df: DataFrame, rules: dict, *names: str) -> DataFrame:
    picked = {name: rules[name] for name in names}
    severities = {name: severity for name, (severity, _) in picked.items()}
    return quality.findings([quality.count_rules(df, picked)], severities).select("rule", "severity", "n_bad")


@query("objects_dirty")
def dq_coordinates(objects: DataFrame) -> DataFrame:
    return _rules(objects, quality.object_row_rules(), "latitude_out_of_range", "longitude_out_of_range")


@query("objects_dirty")
def dq_null_counts(objects: DataFrame) -> DataFrame:
    return _rules(objects, quality.object_row_rules(),
                  *[f"null_{c}" for c in s.REQUIRED_AT_IMPORT["objects"]])


@query("diagnostics_dirty")
def dq_dates(diagnostics: DataFrame) -> DataFrame:
    return _rules(diagnostics, quality.diagnostic_row_rules(diagnostics.columns), "null_date", "invalid_date")


@query("diagnostics_dirty")
def dq_missing_depth(diagnostics: DataFrame) -> DataFrame:
    return _rules(diagnostics, quality.diagnostic_row_rules(diagnostics.columns), "missing_param1")


@query("diagnostics_dirty", "objects")
def dq_orphans(diagnostics: DataFrame, objects: DataFrame) -> DataFrame:
    return quality.orphan_ids(diagnostics, objects)


@query("objects", "diagnostics")
def dq_empty(objects: DataFrame, diagnostics: DataFrame) -> DataFrame:
    return (quality.count_empty(objects).withColumn("table_name", F.lit("objects"))
            .unionByName(quality.count_empty(diagnostics).withColumn("table_name", F.lit("diagnostics"))))


add("validate_objects", quality.validate_objects, "objects_dirty")
add("validate_diagnostics", quality.validate_diagnostics, "diagnostics_dirty", "objects")
add("startup_validation", quality.validate_at_startup, "objects_dirty", "diagnostics_dirty")

# --- listings and joins ------------------------------------------------------------

add("list_trunklines", lambda pipelines: pipelines, "pipelines")
add("list_objects", listing.list_objects, "objects", pipeline_id=LINE, object_type="crane")
add("object_profile", listing.object_profile, "objects", object_id=7)
add("object_profiles", listing.object_profile, "objects")
add("list_diagnostics", listing.list_diagnostics, "diagnostics", "objects",
    defect_only=True, date_from="1996-01-01", date_to="2000-12-31")


@query("diagnostics")
def filter_date_range(diagnostics: DataFrame) -> DataFrame:
    """Two years of a stored table, which is a folder per year."""
    spark, path = diagnostics.sparkSession, work_folder(diagnostics.sparkSession, "by-year")
    imports.write_laid_out(diagnostics, "diagnostics", path)
    kinds = T.StructType([*diagnostics.schema.fields, T.StructField(listing.DATE_PART, T.StringType())])
    return listing.date_range(spark.read.schema(kinds).parquet(path), "1997-01-01", "1998-12-31")


add("clean_non_finite", clean_non_finite, "diagnostics_nonfinite")
add("defects_only", listing.defects_only, "diagnostics")
add("high_risk_only", listing.high_risk_only, "diagnostics")
add("top_risks_by_trunkline", forecast.top_risks_on_trunkline, "objects", "diagnostics",
    pipeline_id=LINE, limit=100)
add("diagnostics_of_trunkline", listing.on_line, "diagnostics", "objects", pipeline_id=LINE)
add("orphan_diagnostics", listing.orphans, "diagnostics_dirty", "objects")


@query("diagnostics_dirty", "objects")
def enrich_left(diagnostics: DataFrame, objects: DataFrame) -> DataFrame:
    return listing.with_object(diagnostics, objects, "object_name", "lat", "lon", "pipeline_id")


@query("diagnostics_dirty", "objects")
def enrich_topk_inner(diagnostics: DataFrame, objects: DataFrame) -> DataFrame:
    return stats.top_objects(diagnostics, objects, 100, "object_name", "pipeline_id")


# --- aggregates ----------------------------------------------------------------------

add("dashboard_summary", stats.dashboard_summary, "objects", "diagnostics")
add("method_distribution", stats.method_distribution, "diagnostics")
add("risk_distribution", stats.risk_distribution, "diagnostics")
add("quality_distribution", stats.quality_distribution, "diagnostics")
add("top_defect_objects", stats.top_defect_objects, "diagnostics", "objects")
add("top_risk_objects", stats.top_risk_objects, "diagnostics", "objects")
add("yearly_trend", stats.yearly_trend, "diagnostics")
add("trunkline_stats", stats.trunkline_stats, "pipelines", "objects", "diagnostics")
add("object_history", stats.object_history, "diagnostics")
add("object_totals", stats.object_totals, "objects", "diagnostics")
add("report_summary", stats.report_summary, "diagnostics")
add("report_summary_trunkline", stats.report_summary, "diagnostics", "objects", pipeline_id=LINE)
add("report_methods", stats.method_distribution, "diagnostics", "objects", pipeline_id=LINE)
add("trunkline_polylines", latest.trunkline_polylines, "pipelines", "objects")
add("defect_object_share", stats.defect_object_share, "objects", "diagnostics")
add("defects_last_year", forecast.defects_last_year, "objects", "diagnostics", as_of=AS_OF)

# --- latest, sorted, top-k -------------------------------------------------------------

add("latest_inspection_per_object", latest.latest_per_object, "diagnostics")
add("map_points", latest.map_points, "diagnostics", "objects")
add("map_points_filtered", latest.map_points, "diagnostics", "objects", pipeline_id=LINE,
    method="UZK", defect_only=False, date_from="1996-01-01", date_to="2000-12-31")
add("days_since_first_defect", forecast.days_since_first_defect, "diagnostics")
add("last_defect_depth", forecast.last_defect_depth, "diagnostics")
add("object_diagnostics_sorted", listing.sorted_diagnostics, "diagnostics", sort_by="depth")
add("report_high_risk_top20", report.high_risk_top, "diagnostics", "objects")
add("report_top10_objects", report.top_objects, "diagnostics", "objects")

# --- scalar expressions ------------------------------------------------------------------


@query("diagnostics")
def risk_label_rule(diagnostics: DataFrame) -> DataFrame:
    """With the relative humidity standing in for the repair factor, which no table stores."""
    erf = F.when(F.col("diag_id") % 2 == 0, F.col("humidity") / 100)
    label = criticality.risk_label(F.col("param1"), erf, F.col("quality_grade"))
    return diagnostics.select("diag_id", label.alias("label"))


add("rule_based_class", model.rule_scores, "diagnostics")


@query("diagnostics")
def quality_score(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.select("diag_id", criticality.quality_score(F.col("quality_grade")).alias("score"))


@query("diagnostics_dirty")
def critical_method_flag(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.select("diag_id", "method", criticality.critical_method(F.col("method")).alias("critical"))


def _columns(values: Callable[[], dict]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select("diag_id", *[v.alias(n) for n, v in values().items()])


add("defect_geometry", _columns(criticality.geometry), "diagnostics")
add("condition_norms", _columns(criticality.conditions), "diagnostics")
add("size_flags", _columns(criticality.size_flags), "diagnostics")


add("inspection_year", lambda df: df.select("diag_id", "date", inspection_year().alias("year")),
    "diagnostics_dirty")


@query("objects", "diagnostics")
def next_inspection_date(objects: DataFrame, diagnostics: DataFrame) -> DataFrame:
    return forecast.object_forecast(objects, diagnostics).select("object_id", "next_inspection_date")


@query("objects")
def transliterate(objects: DataFrame) -> DataFrame:
    return objects.select("object_id", text.transliterate(F.col("material")).alias("material"),
                          text.transliterate(F.col("object_name")).alias("object_name"))


@query("diagnostics_dirty", "objects_dirty")
def report_text_cuts(diagnostics: DataFrame, objects: DataFrame) -> DataFrame:
    """Printed form of the defects, their grade as the description."""
    named = listing.with_object(listing.defects_only(diagnostics), objects, "object_name")
    return report.printed_defects(named.withColumn("defect_description", F.col("quality_grade")))


add("report_object_names", report.printed_objects, "objects_dirty")


def _forecast_labels(values: Callable[[], dict]) -> Callable[..., DataFrame]:
    return lambda objects, diagnostics: forecast.object_forecast(objects, diagnostics).select(
        "object_id", *[v.alias(n) for n, v in values().items()])


add("risk_band", _forecast_labels(lambda: {"band": banding.risk_band(F.col("risk_probability"))}),
    "objects", "diagnostics")
add("trend_label", _forecast_labels(lambda: {"label": banding.trend_label(F.col("trend"))}),
    "objects", "diagnostics")
add("depth_flags", _forecast_labels(
    lambda: banding.depth_flags(F.col("current_depth"), F.col("predicted_depth"))),
    "objects", "diagnostics")


@query("alert_events")
def alert_age_bucket(events: DataFrame) -> DataFrame:
    as_of = F.lit(f"{AS_OF} 09:30:00").cast("timestamp")
    return alerts.current_alerts(events).select(
        "alert_id", banding.alert_age(F.col("created_at"), as_of).alias("age"))


add("locate_on_trunkline", latest.locate_on_trunkline, "objects")

# --- classifier -------------------------------------------------------------------------

add("defect_features", lambda df: model.defect_features(df, "diag_id"), "diagnostics")
add("class_weights", model.class_weights, "diagnostics")

_fits: dict[tuple, model.Fit] = {}


def fitted(spark: SparkSession, sf_dir: str) -> model.Fit:
    """The one fit that all queries of a session and folder share, while its files stay as they are."""
    files = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "_metadata.file_path", "_metadata.file_modification_time").groupBy("file_path").agg(F.max("file_modification_time").alias("at"))
    state = files.agg(F.count("*"), F.max("at"), F.bit_xor(F.xxhash64("file_path", "at"))).first()
    key = (spark.sparkContext.applicationId, sf_dir, *state)
    if key not in _fits:
        _fits[key] = model.train(view(spark, sf_dir, "diagnostics"))
    return _fits[key]


def train_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was learnt: labels in order, number of rows, and whether there is a model."""
    fit = fitted(spark, sf_dir)
    return fit.metrics.select("n_samples", F.array_join("classes", ",").alias("classes"),
                              F.lit(fit.is_trained).alias("is_trained"))


def model_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(spark, sf_dir).metrics.select("train_accuracy", "test_accuracy", "n_samples")


def score_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = model.score(fitted(spark, sf_dir), view(spark, sf_dir, "diagnostics"))
    return scored.select("diag_id", "ml_label", "confidence", "model_type",
                         *[F.col("probabilities")[c].alias(f"p_{c}") for c in s.RISK_LABELS])


def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.feature_importance(spark, fitted(spark, sf_dir))


def accuracy_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the accuracies lie in their bands, next to the number of rows they are of."""
    return model_accuracy(spark, sf_dir).select(
        "n_samples", F.col("train_accuracy").between(0.97, 1.0).alias("train_in_band"),
        F.col("test_accuracy").between(0.93, 1.0).alias("test_in_band"))


def score_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows scored, and how many of them break what holds of every score."""
    shares = F.array(*[F.col(f"p_{c}") for c in s.RISK_LABELS])
    own = F.element_at(F.map_from_arrays(F.array(*map(F.lit, s.RISK_LABELS)), shares), F.col("ml_label"))
    total = F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)
    return score_defects(spark, sf_dir).agg(
        F.count("*").alias("n_rows"), F.count_distinct("diag_id").alias("n_ids"),
        F.count_if(own < F.array_max(shares)).alias("n_not_likeliest"),
        F.count_if(F.abs(total - 100) > 1e-6).alias("n_not_whole"),
        F.count_if(F.abs(F.col("confidence") - F.array_max(shares)) > 0.0051).alias("n_wrong_confidence"),
        F.count_if(F.col("model_type") != "ml").alias("n_by_rule"))


def untrained_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores without a model, which the rules decide."""
    scored = model.score(model.Fit(None, [], None), view(spark, sf_dir, "diagnostics"))
    return scored.select("diag_id", "ml_label", "confidence", "model_type",
                         F.element_at("probabilities", F.col("ml_label")).alias("probability"))


def importance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs named, whether their importances sum to 1, and whether any is negative."""
    return feature_importance(spark, sf_dir).agg(
        F.array_join(F.sort_array(F.collect_list("feature")), ",").alias("features"),
        (F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"),
        F.count_if(F.col("importance") < 0).alias("n_negative"))


for _build in (train_model, model_accuracy, score_defects, feature_importance, accuracy_check, score_check,
               untrained_scores, importance_check):
    QUERIES[_build.__name__] = _build

# --- forecast ------------------------------------------------------------------------------

add("depth_trend", forecast.depth_trend, "diagnostics")
add("depth_trend_dirty", forecast.depth_trend, "diagnostics_dirty")
add("object_forecast_dirty", forecast.object_forecast, "objects", "diagnostics_dirty")


@query("objects", "diagnostics")
def trend_class(objects: DataFrame, diagnostics: DataFrame) -> DataFrame:
    return (forecast.object_forecast(objects, diagnostics)
            .where(F.col("trend").isNotNull()).groupBy("trend").agg(F.count("*").alias("objects")))


@query("diagnostics")
def risk_tier(diagnostics: DataFrame) -> DataFrame:
    fitted_lines = forecast.inspection_profile(diagnostics).where(forecast.HAS_LINE)
    tier = forecast.risk_tier(F.col("predicted_depth"), F.col("current_depth"))
    return fitted_lines.select("object_id", *[v.alias(n) for n, v in tier.items()])


add("object_forecast", forecast.object_forecast, "objects", "diagnostics")
add("top_risks", forecast.top_risks, "objects", "diagnostics")
add("critical_objects", forecast.critical_objects, "objects", "diagnostics")
add("trunkline_forecast", forecast.trunkline_forecast, "pipelines", "objects", "diagnostics", as_of=AS_OF)


@query("pipelines", "objects", "diagnostics")
def trunkline_recommendation(pipelines: DataFrame, objects: DataFrame, diagnostics: DataFrame) -> DataFrame:
    return (forecast.trunkline_forecast(pipelines, objects, diagnostics, AS_OF)
            .select("pipeline_id", "recommendation"))


add("forecast_dashboard_summary", forecast.forecast_dashboard_summary, "objects", "diagnostics")
add("forecast_dashboard_trunklines", forecast.forecast_dashboard_trunklines,
    "pipelines", "objects", "diagnostics", as_of=AS_OF)
add("report_recommendations", report.recommendations, "diagnostics")

# --- alerts -----------------------------------------------------------------------------------

add("defect_alerts", alerts.defect_alerts, "diagnostics", "objects")


def _as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query("objects", "diagnostics_dirty")
def run_alerts(objects: DataFrame, dirty: DataFrame) -> DataFrame:
    log = store.import_log(objects.sparkSession, _import_two(objects, dirty))
    return alerts.run_alerts(log).select("message", "type")


@query("pipelines")
def report_alerts(pipelines: DataFrame) -> DataFrame:
    """One finished report per line."""
    return alerts.report_alerts(pipelines.select(
        F.col("pipeline_id").alias("report_id"), F.lit("PDF").alias("report_type"), "pipeline_id"))


def training_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.training_alerts(fitted(spark, sf_dir).metrics.select(
        F.lit(fitted(spark, sf_dir).fit_id).alias("fit_id"), F.col("test_accuracy").alias("accuracy"),
        F.lit(len(s.FEATURES)).alias("features_count")))


QUERIES["training_alerts"] = training_alerts


def training_alert_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of the training alert, whatever the fit."""
    told = F.regexp_extract("message", r"([0-9.]+)%", 1).cast("double")
    return training_alerts(spark, sf_dir).agg(
        F.count("*").alias("n_alerts"), F.count_if(F.col("type") == "success").alias("n_success"),
        F.max("features_count").alias("features_count"),
        F.count_if(F.abs(told - F.col("accuracy") * 100) > 0.0051).alias("n_wrong_accuracy"))


QUERIES["training_alert_check"] = training_alert_check


@query("alert_events")
def list_alerts(events: DataFrame) -> DataFrame:
    return _as_text(alerts.list_alerts(alerts.current_alerts(events), unread_only=True, limit=50))


@query("alert_events")
def current_alerts(events: DataFrame) -> DataFrame:
    return _as_text(alerts.current_alerts(events))


@query("alert_events")
def read_all_marks(events: DataFrame) -> DataFrame:
    marks = alerts.read_all_marks(events)
    return marks.withColumn("event_at", F.date_format("event_at", "yyyy-MM-dd HH:mm:ss"))


@query("alert_events")
def unread_count(events: DataFrame) -> DataFrame:
    return alerts.unread_count(alerts.current_alerts(events))


# --- streams ------------------------------------------------------------------------------------

def _drop_folder(diagnostics: DataFrame) -> str:
    """The table as a drop folder of several files."""
    folder = work_folder(diagnostics.sparkSession, "stream")
    tables.complete(diagnostics, s.DIAGNOSTICS).repartition(6).write.parquet(f"{folder}/drop")
    return folder


@query("diagnostics_dirty", "objects")
def stream_import(diagnostics: DataFrame, objects: DataFrame) -> DataFrame:
    """Six files in three batches; repeated keys lie in different ones."""
    spark, folder = diagnostics.sparkSession, _drop_folder(diagnostics)
    stream = import_streams.watch(spark, f"{folder}/drop", files_per_batch=2)
    import_streams.stream_import(stream, objects, f"{folder}/arrived", f"{folder}/state").awaitTermination()
    rows = import_streams.judged_arrivals(spark, f"{folder}/arrived")
    return rows.select("diag_id", "object_id", "date", (F.size("reasons") == 0).alias("is_accepted"),
                       F.array_join("reasons", ",").alias("reasons"))


@query("diagnostics", "objects")
def stream_defect_alerts(diagnostics: DataFrame, objects: DataFrame) -> DataFrame:
    spark, folder = diagnostics.sparkSession, _drop_folder(diagnostics)
    stream = import_streams.watch(spark, f"{folder}/drop", files_per_batch=2)
    alert_streams.stream_alerts(stream, objects, f"{folder}/log", f"{folder}/state").awaitTermination()
    return alert_streams.defect_alerts_of(alert_streams.alert_events(spark, f"{folder}/log"))
