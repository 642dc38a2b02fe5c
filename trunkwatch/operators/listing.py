"""Filtered listings.

An argument left ``None`` means "no filter"; 0 and "" are ordinary values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, Window, functions as F

from trunkwatch.functions.cleaning import clean_non_finite, or_zero

DATE_PART, NO_YEAR = "date_part", "none"
# Tasks between those that read and the one that merges last; decides no result.
_MERGING_TASKS = 64


def _matching(df: DataFrame, **wanted) -> DataFrame:
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def date_part(date: str = "date") -> Column:
    """What stored diagnostics are partitioned by: the first four digits of the date's text, or that it has none.

    They order as the whole texts do, so a range of texts is a range of parts.
    """
    year = F.substring(date, 1, 4)
    return F.when(year.rlike("^[0-9]{4}$"), year).otherwise(NO_YEAR)


def date_range(df: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Rows whose ISO date text lies in the closed range.

    Of a table with the column of :func:`date_part` only the parts of the range are
    read, and those without a year; the column is left out.
    """
    whole = DATE_PART in df.columns
    for bound, at, within in ((date_from, F.col("date") >= date_from, F.col(DATE_PART) >= (date_from or "")[:4]),
                              (date_to, F.col("date") <= date_to, F.col(DATE_PART) <= (date_to or "")[:4])):
        if bound is not None:
            df = df.where(at)
            if whole:
                df = df.where(within | (F.col(DATE_PART) == NO_YEAR))
    return df.drop(DATE_PART) if whole else df


def defects_only(diagnostics: DataFrame) -> DataFrame:
    # a bare comparison drops nulls as well, and it reaches the scan
    return diagnostics.where(F.col("defect_found") == F.lit(True))


def high_risk_only(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.where(F.col("ml_label") == "high")


def on_line(diagnostics: DataFrame, objects: DataFrame, pipeline_id: str) -> DataFrame:
    """Diagnostics whose object lies on the line; copies of an object do not multiply rows."""
    there = objects.where(F.col("pipeline_id") == pipeline_id).select("object_id")
    return diagnostics.join(there, "object_id", "left_semi")


def orphans(diagnostics: DataFrame, objects: DataFrame) -> DataFrame:
    """Diagnostics of objects that are not in the table, null ids among them."""
    return diagnostics.join(objects.select("object_id"), "object_id", "left_anti")


def with_object(rows: DataFrame, objects: DataFrame, *columns: str, how: str = "left") -> DataFrame:
    """Object attributes next to each row; ``left`` keeps orphans, ``inner`` drops them."""
    return rows.join(objects.select("object_id", *columns), "object_id", how)


def group_apart(df: DataFrame, key: str) -> GroupedData:
    """Groups by ``key`` for an aggregate that is joined to many rows per key.

    AQE splits the partition of a hot key only when both sides of a join come
    straight from a shuffle, and an aggregate by the key alone is joined as it
    lies. Grouped by the key and a hash of it the groups are the same, but the
    result, one row per key, is shuffled once more for the join, and the hot rows
    opposite can be split.
    """
    return df.groupBy(key, F.pmod(F.xxhash64(key), F.lit(1009)).alias("shard"))


def list_objects(objects: DataFrame, pipeline_id: str | None = None,
                 object_type: str | None = None) -> DataFrame:
    return _matching(objects, pipeline_id=pipeline_id, object_type=object_type)


def object_profile(objects: DataFrame, object_id: int | None = None) -> DataFrame:
    """One object (no row when unknown) or all of them, without NaN and infinities."""
    return clean_non_finite(_matching(objects, object_id=object_id))


def filter_diagnostics(diagnostics: DataFrame, objects: DataFrame, *, object_id: int | None = None,
                       method: str | None = None, pipeline_id: str | None = None,
                       ml_label: str | None = None, defect_only: bool = False,
                       date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    rows = _matching(diagnostics, object_id=object_id, method=method, ml_label=ml_label)
    rows = date_range(rows, date_from, date_to)
    if defect_only:
        rows = defects_only(rows)
    if pipeline_id is not None:
        rows = on_line(rows, objects, pipeline_id)
    return rows


def newest_first() -> list[Column]:
    return [F.desc_nulls_last("date"), F.asc("diag_id")]


def newest(rows: DataFrame, k: int) -> DataFrame:
    """The newest ``k`` rows, merged in two levels.

    Every task offers its own top ``k`` to one of some tasks that merge them, and
    those theirs to the last: however many tasks there are, and whatever dates the
    rows have, none merges the tops of all. Rows are read once.
    """
    group = F.pmod(F.spark_partition_id(), F.lit(_MERGING_TASKS))
    order = Window.partitionBy("_group").orderBy(*newest_first())
    tops = (rows.withColumn("_group", group).withColumn("_place", F.row_number().over(order))
            .where(F.col("_place") <= k).drop("_group", "_place"))
    return tops.orderBy(*newest_first()).limit(k)


def list_diagnostics(diagnostics: DataFrame, objects: DataFrame, limit: int = 1000,
                     **filters) -> DataFrame:
    """Newest ``limit`` diagnostics that pass the filters, with their object's attributes.

    The cut comes before the join, so an object stored twice may show a row twice.
    """
    shown = newest(filter_diagnostics(diagnostics, objects, **filters), limit)
    listed = with_object(shown, objects, "object_name", "lat", "lon", "pipeline_id")
    return clean_non_finite(listed).orderBy(*newest_first())


def sorted_diagnostics(diagnostics: DataFrame, object_id: int | None = None,
                       sort_by: str = "date", descending: bool = True) -> DataFrame:
    """An object's diagnostics (or all, object by object) by date or by depth."""
    if sort_by == "depth":
        key = or_zero(F.col("param1"))
    elif sort_by == "date":
        key = F.col("date")
    else:
        raise ValueError(f"sort_by must be 'date' or 'depth', not {sort_by!r}")
    key = key.desc_nulls_last() if descending else key.asc_nulls_last()
    rows = clean_non_finite(_matching(diagnostics, object_id=object_id))
    return rows.orderBy(F.asc_nulls_last("object_id"), key, F.asc("diag_id"))
