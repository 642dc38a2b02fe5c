"""Counts, rates and top-k over diagnostics.

Every aggregate here reduces map-side before its shuffle, so a hot object or
line costs one partial row per task. Totals of several tables are brought
together by a union that is summed up, which needs no join at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trunkwatch.functions.cleaning import inspection_year, is_defect, percent
from trunkwatch.operators.listing import defects_only, high_risk_only, on_line, with_object


def _scope(diagnostics: DataFrame, objects: DataFrame | None, pipeline_id: str | None) -> DataFrame:
    return diagnostics if pipeline_id is None else on_line(diagnostics, objects, pipeline_id)


def dashboard_summary(objects: DataFrame, diagnostics: DataFrame) -> DataFrame:
    counts = objects.agg(F.count("*").alias("total_objects")).unionByName(
        diagnostics.agg(F.count("*").alias("total_inspections"),
                        F.count_if(is_defect()).alias("total_defects")),
        allowMissingColumns=True)
    names = ["total_objects", "total_inspections", "total_defects"]
    totals = counts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    return totals.withColumn(
        "defect_rate", percent(F.col("total_defects"), F.col("total_inspections")))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; nulls are not counted."""
    return (df.where(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count("*").alias("count"))
            .orderBy(F.desc("count"), column))


def method_distribution(diagnostics: DataFrame, objects: DataFrame | None = None,
                        pipeline_id: str | None = None) -> DataFrame:
    return value_counts(_scope(diagnostics, objects, pipeline_id), "method")


def risk_distribution(diagnostics: DataFrame) -> DataFrame:
    return value_counts(diagnostics, "ml_label")


def quality_distribution(diagnostics: DataFrame) -> DataFrame:
    return value_counts(defects_only(diagnostics), "quality_grade")


def top_objects(diagnostics: DataFrame, objects: DataFrame, k: int, *columns: str,
                count_name: str = "count") -> DataFrame:
    """The ``k`` objects with most rows. Attributes are joined after the cut, so an
    orphan among them shortens the list."""
    order = [F.desc(count_name), F.asc("object_id")]
    top = (diagnostics.where(F.col("object_id").isNotNull()).groupBy("object_id")
           .agg(F.count("*").alias(count_name))
           .orderBy(*order).limit(k))
    return with_object(top, objects, *columns, how="inner").orderBy(*order)


def top_defect_objects(diagnostics: DataFrame, objects: DataFrame, k: int = 5) -> DataFrame:
    return top_objects(defects_only(diagnostics), objects, k, "object_name", "pipeline_id")


def top_risk_objects(diagnostics: DataFrame, objects: DataFrame, k: int = 5) -> DataFrame:
    return top_objects(high_risk_only(diagnostics), objects, k, "object_name", "pipeline_id")


def yearly_trend(diagnostics: DataFrame) -> DataFrame:
    return (diagnostics.select(inspection_year().alias("year"), "diag_id", is_defect().alias("defect"))
            .where(F.col("year").isNotNull()).groupBy("year")
            .agg(F.count("diag_id").alias("inspections"), F.count_if("defect").alias("defects"))
            .orderBy("year"))


def per_object(diagnostics: DataFrame) -> DataFrame:
    """Inspections, defects and high labels of each object."""
    return (diagnostics.where(F.col("object_id").isNotNull()).groupBy("object_id")
            .agg(F.count("*").alias("inspections"),
                 F.count_if(is_defect()).alias("defects"),
                 F.count_if(F.col("ml_label") == "high").alias("high")))


def objects_of_lines(objects: DataFrame) -> DataFrame:
    """Each object once per line, with the number of its rows there."""
    return (objects.where(F.col("pipeline_id").isNotNull())
            .groupBy("pipeline_id", "object_id").agg(F.count("*").alias("copies")))


def trunkline_stats(pipelines: DataFrame, objects: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Object, inspection, defect and high-risk counts of every line, zeros included.

    Diagnostics are counted per object before the object table joins in, so the
    join sees one row per object however hot it is.
    """
    names = ["objects_count", "inspections_count", "defects_count", "high_risk_count"]
    counts = (objects_of_lines(objects).join(per_object(diagnostics), "object_id", "left")
              .groupBy("pipeline_id")
              .agg(F.sum("copies").alias("objects_count"),
                   F.sum("inspections").alias("inspections_count"),
                   F.sum("defects").alias("defects_count"),
                   F.sum("high").alias("high_risk_count")))
    return (pipelines.select("pipeline_id", "name").join(counts, "pipeline_id", "left")
            .fillna(0, names)
            .withColumn("needs_attention", F.col("high_risk_count") > 0)
            .orderBy("pipeline_id"))


def object_history(diagnostics: DataFrame, object_id: int | None = None) -> DataFrame:
    """Inspections, defects and high labels by object and year."""
    if object_id is not None:
        diagnostics = diagnostics.where(F.col("object_id") == object_id)
    return (diagnostics.where(F.col("object_id").isNotNull())
            .withColumn("year", inspection_year()).where(F.col("year").isNotNull())
            .groupBy("object_id", "year")
            .agg(F.count("diag_id").alias("total_inspections"),
                 F.count_if(is_defect()).alias("defects_found"),
                 F.count_if(F.col("ml_label") == "high").alias("high_risk"))
            .orderBy("object_id", "year"))


def object_totals(objects: DataFrame, diagnostics: DataFrame,
                  object_id: int | None = None) -> DataFrame:
    """Inspections and defects of every object, 0 where it was never inspected."""
    if object_id is not None:
        objects = objects.where(F.col("object_id") == object_id)
        diagnostics = diagnostics.where(F.col("object_id") == object_id)
    return (objects.select("object_id").distinct()
            .join(per_object(diagnostics), "object_id", "left")
            .select("object_id",
                    F.coalesce("inspections", F.lit(0)).alias("total_inspections"),
                    F.coalesce("defects", F.lit(0)).alias("defects_count")))


def report_summary(diagnostics: DataFrame, objects: DataFrame | None = None,
                   pipeline_id: str | None = None) -> DataFrame:
    label = F.col("ml_label")
    totals = _scope(diagnostics, objects, pipeline_id).agg(
        F.count("*").alias("total_inspections"),
        F.count_if(is_defect()).alias("total_defects"),
        F.count_if(label == "normal").alias("risk_normal"),
        F.count_if(label == "medium").alias("risk_medium"),
        F.count_if(label == "high").alias("risk_high"))
    return totals.withColumn(
        "defect_rate", percent(F.col("total_defects"), F.col("total_inspections")))


def defect_object_share(objects: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Share of each line's objects that ever had a defect."""
    found = per_object(defects_only(diagnostics)).select("object_id", "defects")
    return (objects_of_lines(objects).join(found, "object_id", "left")
            .groupBy("pipeline_id")
            .agg(F.sum("copies").alias("total_objects"),
                 F.count_if(F.col("defects") > 0).alias("defect_objects"))
            .withColumn("defect_share", F.col("defect_objects") / F.col("total_objects")))
