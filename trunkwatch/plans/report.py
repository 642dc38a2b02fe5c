"""The tables a report is made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trunkwatch import schema as s
from trunkwatch.functions.text import cut, object_type_name, transliterate
from trunkwatch.operators import stats
from trunkwatch.operators.listing import (
    defects_only, high_risk_only, newest, newest_first, on_line, with_object)


def _scope(diagnostics: DataFrame, objects: DataFrame, pipeline_id: str | None) -> DataFrame:
    return diagnostics if pipeline_id is None else on_line(diagnostics, objects, pipeline_id)


def high_risk_top(diagnostics: DataFrame, objects: DataFrame, pipeline_id: str | None = None,
                  k: int = 20) -> DataFrame:
    """The newest ``k`` high-risk rows with their object's name and line.

    The join comes before the cut, as copies of an object count. Only the newest
    ``k`` diagnostics can be among the newest ``k`` joined rows, so those are
    picked first and the join stays small.
    """
    rows = high_risk_only(_scope(diagnostics, objects, pipeline_id))
    return (with_object(newest(rows, k), objects, "object_name", "pipeline_id")
            .orderBy(*newest_first(), "pipeline_id", "object_name").limit(k))


def top_objects(diagnostics: DataFrame, objects: DataFrame, pipeline_id: str | None = None,
                k: int = 10) -> DataFrame:
    rows = defects_only(_scope(diagnostics, objects, pipeline_id))
    return stats.top_objects(rows, objects, k, "object_name", "object_type", "pipeline_id",
                             count_name="defect_count")


def recommendations(diagnostics: DataFrame, objects: DataFrame | None = None,
                    pipeline_id: str | None = None) -> DataFrame:
    """Advice that follows from the summary, in order."""
    summary = stats.report_summary(diagnostics, objects, pipeline_id)
    high, medium, rate = F.col("risk_high"), F.col("risk_medium"), F.col("defect_rate")
    lines = F.filter(F.array(
        F.when(high > 0, F.format_string(s.LINE_HIGH, high)),
        F.when(medium > 10, F.format_string(s.LINE_MEDIUM, medium)),
        F.when(rate > 50, F.format_string(s.LINE_DEFECT_RATE, rate.cast("string"))),
        F.lit(s.LINE_CONTINUE),
        F.lit(s.LINE_METHODS)), lambda line: line.isNotNull())
    return summary.select(F.posexplode(lines).alias("position", "line"))


def printed_defects(rows: DataFrame) -> DataFrame:
    """Defect rows as printed: Latin letters, cut to the width of their column."""
    return rows.select(
        "diag_id",
        cut(F.col("date"), 10).alias("date"),
        cut(transliterate(F.col("object_name")), 35).alias("object"),
        F.coalesce("method", F.lit("-")).alias("method"),
        cut(transliterate(F.col("defect_description")), 45).alias("description"))


def printed_objects(rows: DataFrame) -> DataFrame:
    return rows.select(
        "object_id",
        cut(transliterate(F.col("object_name")), 40).alias("object"),
        object_type_name(F.col("object_type")).alias("type"),
        F.coalesce("pipeline_id", F.lit("-")).alias("pipeline"))
