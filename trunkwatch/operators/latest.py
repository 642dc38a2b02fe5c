"""Latest inspection per object, map points and line geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trunkwatch.functions.cleaning import clean_non_finite
from trunkwatch.functions.geo import along
from trunkwatch.operators.listing import filter_diagnostics, group_apart


def recency(day: Column, diag_id: Column) -> Column:
    """Day and then ``diag_id`` in one decimal number.

    Being of fixed width it keeps ``max_by`` in a hash aggregate, where a struct
    would turn the whole aggregate into a sort.
    """
    shift = F.lit("10000000000000000000").cast("decimal(20,0)")
    return F.unix_date(day).cast("decimal(10,0)") * shift + diag_id


def latest_per_object(diagnostics: DataFrame) -> DataFrame:
    """Newest inspection of each object; the larger ``diag_id`` wins within a day.

    The greatest row by date and id is an aggregate that merges map-side, so an
    object with very many inspections sends one row per task. Structs order a null
    date before any other, which makes it the last resort.
    """
    others = [c for c in diagnostics.columns if c not in ("object_id", "date", "diag_id")]
    greatest = F.max(F.struct("date", "diag_id", *others)).alias("newest")
    return (diagnostics.where(F.col("object_id").isNotNull()).groupBy("object_id").agg(greatest)
            .select([F.col(c) if c == "object_id" else F.col(f"newest.{c}") for c in diagnostics.columns]))


def one_per_object(objects: DataFrame, *columns: str, apart: bool = False) -> DataFrame:
    """Objects without repeated ids: the smallest set of attributes is kept.

    ``apart`` is for joins with raw diagnostics, see :func:`group_apart`.
    """
    groups = group_apart(objects, "object_id") if apart else objects.groupBy("object_id")
    return groups.agg(F.min(F.struct(*columns)).alias("kept")).select("object_id", "kept.*")


def map_points(diagnostics: DataFrame, objects: DataFrame, *, pipeline_id: str | None = None,
               ml_label: str | None = None, method: str | None = None, defect_only: bool = True,
               date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """One point per object: its latest matching diagnostic at the object's place.

    Only what a point shows is read and aggregated, and only of objects on the
    line, once one is asked for.
    """
    rows = filter_diagnostics(diagnostics, objects, method=method, ml_label=ml_label, pipeline_id=pipeline_id,
                              defect_only=defect_only, date_from=date_from, date_to=date_to)
    rows = rows.select("object_id", "date", "diag_id", "ml_label", "method", "defect_description", "quality_grade")
    if pipeline_id is not None:
        objects = objects.where(F.col("pipeline_id") == pipeline_id)
    places = one_per_object(objects, "object_name", "object_type", "lat", "lon", "pipeline_id")
    how = "left" if pipeline_id is None else "inner"
    points = clean_non_finite(latest_per_object(rows).join(places, "object_id", how))
    return points.select(
        "object_id", "object_name", "object_type", "pipeline_id",
        F.coalesce("lat", F.lit(0.0)).alias("lat"), F.coalesce("lon", F.lit(0.0)).alias("lon"),
        "ml_label", "method", "date", "defect_description", "quality_grade")


def trunkline_polylines(pipelines: DataFrame, objects: DataFrame) -> DataFrame:
    """The vertices of every line, in order; lines without objects have none.

    One row per vertex instead of one array per line: a line may hold any
    number of objects, and the global sort cuts a long one over many tasks.
    """
    return (pipelines.select("pipeline_id", "name")
            .join(objects.select("pipeline_id", "object_id", "lat", "lon"), "pipeline_id")
            .orderBy("pipeline_id", "object_id"))


def locate_on_trunkline(objects: DataFrame) -> DataFrame:
    """Where each object would lie on the straight way between the ends of its line.

    The ends are the objects with the lowest and the highest id; how far along an
    object lies follows from its id between those two.
    """
    object_id = F.col("object_id")
    ends = group_apart(objects, "pipeline_id").agg(
        F.min("object_id").alias("first_id"), F.max("object_id").alias("last_id"),
        F.min_by("lat", object_id).alias("start_lat"), F.min_by("lon", object_id).alias("start_lon"),
        F.max_by("lat", object_id).alias("end_lat"), F.max_by("lon", object_id).alias("end_lon"))
    ratio = F.coalesce(
        F.try_divide(object_id - F.col("first_id"), F.col("last_id") - F.col("first_id")), F.lit(0.0))
    return (objects.select("object_id", "pipeline_id").join(ends, "pipeline_id")
            .select("object_id", "pipeline_id",
                    along(F.col("start_lat"), F.col("end_lat"), ratio).alias("lat"),
                    along(F.col("start_lon"), F.col("end_lon"), ratio).alias("lon")))
