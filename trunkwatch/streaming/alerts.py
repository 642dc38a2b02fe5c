"""Defect alerts as diagnostics arrive, one per diagnostic for good."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from trunkwatch import schema as s
from trunkwatch.operators.alerts import created_events, defect_alerts
from trunkwatch.operators.listing import defects_only
from trunkwatch.sources.store import append_events, read_events

DETAILS = ("pipeline_id", "object_id", "risk_level", "category")
#: How long a diagnostic is remembered after it arrived.
REMEMBERED = "7 days"


def log_alerts(batch: DataFrame, batch_id: int, objects: DataFrame, log: str) -> None:
    """Appends the created events of one batch, in a folder of its own, so a repeated
    batch replaces itself. The join is a batch join, whose hot objects are split."""
    events = created_events(defect_alerts(batch, objects), F.current_timestamp(), *DETAILS)
    append_events(events, log, s.ALERT_EVENTS, f"batch_id={batch_id}")


def stream_alerts(stream: DataFrame, objects: DataFrame, log: str, checkpoint: str,
                  remembered: str = REMEMBERED) -> StreamingQuery:
    """Writes the alerts of a stream of diagnostics to an event log.

    Diagnostics are remembered for a time after they arrived, and one that is
    delivered again within it adds no event. Inspections can be years old, so the
    time is that of arrival. Beyond it the log grows by an event, but by no alert: an
    alert's id comes from its diagnostic, and the log is read as a fold by that id.
    """
    def one(batch: DataFrame, batch_id: int) -> None:
        log_alerts(batch.drop("arrived_at"), batch_id, objects, log)

    fresh = (defects_only(stream).withColumn("arrived_at", F.current_timestamp())
             .withWatermark("arrived_at", remembered).dropDuplicatesWithinWatermark(["diag_id"]))
    return (fresh.writeStream.foreachBatch(one)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def alert_events(spark: SparkSession, log: str) -> DataFrame:
    """The log as the event table that the alert operators fold."""
    return read_events(spark, log, s.ALERT_EVENTS)


def defect_alerts_of(events: DataFrame) -> DataFrame:
    """The defect alerts of a log, each once, as they were first created."""
    first = F.min_by(F.struct("message", "type", "metadata"), "event_at").alias("alert")
    details = F.col("alert.metadata")
    return (events.where(F.col("action") == "created").groupBy("alert_id").agg(first)
            .select("alert_id", "alert.message", "alert.type", details["pipeline_id"].alias("pipeline_id"),
                    details["object_id"].cast("long").alias("object_id"),
                    details["risk_level"].alias("risk_level"), details["category"].alias("category")))
