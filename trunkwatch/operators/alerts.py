"""Alerts from findings, and their state as the fold of an append-only event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trunkwatch import schema as s
from trunkwatch.operators.latest import one_per_object
from trunkwatch.operators.listing import defects_only
from trunkwatch.session import written

DEFECT = "defect_detection"


def alert_type(risk_level: Column) -> Column:
    return (F.when(risk_level == "high", "error").when(risk_level == "medium", "warning")
            .otherwise("info"))


def defect_message(pipeline_id: Column, object_id: Column, risk_level: Column) -> Column:
    suffix = (F.when(risk_level == "high", s.ALERT_SUFFIX_HIGH)
              .when(risk_level == "medium", s.ALERT_SUFFIX_MEDIUM).otherwise(""))
    text = F.format_string(s.ALERT_DEFECT, F.coalesce(pipeline_id, F.lit("-")), object_id.cast("string"))
    return F.concat(text, suffix)


def defect_alerts(diagnostics: DataFrame, objects: DataFrame) -> DataFrame:
    """One alert per defect. Its id comes from the diagnostic, so repeating the
    derivation repeats no alert."""
    lines = one_per_object(objects, "pipeline_id", apart=True)
    label = F.col("ml_label")
    return (defects_only(diagnostics).join(lines, "object_id", "left")
            .select(F.concat_ws("-", F.lit(DEFECT), "diag_id").alias("alert_id"),
                    defect_message(F.col("pipeline_id"), F.col("object_id"), label).alias("message"),
                    alert_type(label).alias("type"),
                    "pipeline_id", "object_id", label.alias("risk_level"),
                    F.lit(DEFECT).alias("category")))


def created_events(alerts: DataFrame, event_at: Column, *metadata: str) -> DataFrame:
    """``created`` events for the log; the named columns become metadata."""
    pairs: list[Column] = []
    for name in metadata:
        pairs += [F.lit(name), F.col(name).cast("string")]
    return alerts.select(
        "alert_id", F.lit("created").alias("action"), event_at.alias("event_at"), "message", "type",
        (F.create_map(*pairs) if pairs else F.lit(None)).alias("metadata"))


def run_alerts(import_log: DataFrame) -> DataFrame:
    """Success and error alerts of import runs; at most two errors are quoted."""
    ok = F.col("status") == "SUCCESS"
    imported = F.when(
        F.col("table_name") == "objects", F.format_string(s.ALERT_OBJECTS_IMPORTED, "rows", "file")
    ).otherwise(F.format_string(s.ALERT_DIAGNOSTICS_IMPORTED, "rows", "file"))
    quoted = F.array_join(F.slice("errors", 1, 2), "; ")
    return import_log.select(
        F.concat_ws("-", F.lit("import"), "run_id").alias("alert_id"),
        F.when(ok, imported).otherwise(F.format_string(s.ALERT_IMPORT_FAILED, "file", quoted)).alias("message"),
        F.when(ok, "success").otherwise("error").alias("type"))


def report_alerts(reports: DataFrame) -> DataFrame:
    """An alert per finished report ``(report_id, report_type, pipeline_id)``."""
    return reports.select(
        F.concat_ws("-", F.lit("report"), "report_id").alias("alert_id"),
        F.format_string(s.ALERT_REPORT, "report_type", F.coalesce("pipeline_id", F.lit("-"))).alias("message"),
        F.lit("success").alias("type"), "pipeline_id", "report_type",
        F.lit("report_generation").alias("category"))


def training_alerts(fits: DataFrame) -> DataFrame:
    """An alert per fitted model ``(fit_id, accuracy, features_count)``."""
    return fits.select(
        F.concat_ws("-", F.lit("training"), "fit_id").alias("alert_id"),
        F.format_string(s.ALERT_TRAINING, F.col("accuracy") * 100, "features_count").alias("message"),
        F.lit("success").alias("type"), "accuracy", "features_count",
        F.lit("ml_training").alias("category"))


def _folded(events: DataFrame) -> DataFrame:
    """One row per alert that was created: when and what, first read, first deletion."""
    def first(action: str) -> Column:
        return F.min(F.when(F.col("action") == action, F.col("event_at")))

    created = F.when(F.col("action") == "created", F.col("event_at"))
    return (events.where(F.col("alert_id").isNotNull()).groupBy("alert_id")
            .agg(F.min(F.when(created.isNotNull(), F.struct("event_at", "message", "type"))).alias("created"),
                 first("read").alias("read_at"), first("deleted").alias("deleted_at"))
            .where(F.col("created").isNotNull())
            .select("alert_id", F.col("created.event_at").alias("created_at"), "created.message",
                    "created.type", "read_at", "deleted_at"))


def _read_alls(events: DataFrame) -> DataFrame:
    return events.where(F.col("action") == "read_all")


def current_alerts(events: DataFrame) -> DataFrame:
    """Alerts that were not deleted. One is read by its own read event or by any
    later read-all, that is, by the last of them."""
    last = _read_alls(events).agg(F.max("event_at")).scalar()
    read = F.col("read_at").isNotNull() | F.coalesce(F.col("created_at") <= last, F.lit(False))
    return (_folded(events).where(F.col("deleted_at").isNull())
            .select("alert_id", "message", "type", read.alias("is_read"), "created_at"))


def list_alerts(alerts: DataFrame, unread_only: bool = False, limit: int | None = None) -> DataFrame:
    """Newest first; no limit, or 0, lists all."""
    if unread_only:
        alerts = alerts.where(~F.col("is_read"))
    alerts = alerts.orderBy(F.desc("created_at"), F.asc("alert_id"))
    return alerts.limit(limit) if limit else alerts


def unread_count(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count_if(~F.col("is_read")).alias("unread_count"))


def _timeline(events: DataFrame) -> DataFrame:
    """One row per alert that was created and one per instant of a read-all, from one reading of the events.

    ``at`` is when the alert was created or all were read, ``mark`` is null for an alert.
    """
    def first(action: str) -> Column:
        return F.min(F.when(F.col("action") == action, F.col("event_at")))

    mark = F.when(F.col("action") == "read_all", F.col("event_at"))
    mine = F.when(F.col("action") != "read_all", F.col("alert_id"))
    return (events.groupBy(mine.alias("alert_id"), mark.alias("mark"))
            .agg(first("created").alias("created_at"), first("read").alias("read_at"), first("deleted").alias("deleted_at"))
            .where(F.col("mark").isNotNull() | (F.col("alert_id").isNotNull() & F.col("created_at").isNotNull()))
            .select(F.coalesce("mark", "created_at").alias("at"), "mark", "alert_id", "read_at", "deleted_at"))


def next_mark(timeline: DataFrame) -> DataFrame:
    """``timeline`` with ``next_mark``, the first ``mark`` at or after each row's ``at``: an as-of merge.

    Rows are sorted by time over all partitions and written with the number of
    theirs. Within a partition a window carries the marks back in time; what is
    left takes the first mark of a later partition, from one row per partition.
    Rows of one instant differ by ``alert_id``, so that a hot one extends over
    several partitions.
    """
    # within an instant the mark comes last: it is in the partition of its alerts or in a later one
    dealt = timeline.repartitionByRange("at", F.asc_nulls_first("mark"), "alert_id")
    placed = written(dealt.withColumn("part", F.spark_partition_id()), "timeline")
    onwards = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("part").agg(F.min("mark").alias("first"))  # a row per partition
    beyond = first.select("part", F.last("first", ignorenulls=True).over(onwards).alias("beyond"))
    backwards = Window.partitionBy("part").orderBy(F.desc("at"), F.asc_nulls_last("mark"))
    return (placed.withColumn("own", F.last("mark", ignorenulls=True).over(backwards))
            .join(beyond, "part").withColumn("next_mark", F.coalesce("own", "beyond")).drop("part", "own", "beyond"))


def read_all_marks(events: DataFrame) -> DataFrame:
    """How many alerts each read-all newly marked: those created by then and
    neither read nor deleted before it."""
    def not_before(name: str) -> Column:
        return F.col(name).isNull() | (F.col(name) > F.col("next_mark"))

    merged = next_mark(_timeline(events)).where(F.col("next_mark").isNotNull())
    counted = F.count_if(F.col("mark").isNull() & not_before("read_at") & not_before("deleted_at"))
    return merged.groupBy(F.col("next_mark").alias("event_at")).agg(counted.alias("marked_count"))
