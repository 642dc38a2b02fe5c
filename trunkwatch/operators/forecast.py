"""Depth trend per object, risk tiers and roll-ups per line.

The inspections of an object are folded in one hash aggregate: a least-squares
line merges from partial sums, so no task ever holds the history of one object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trunkwatch.functions.cleaning import inspected_on, is_defect, or_zero, rounded
from trunkwatch.operators.latest import one_per_object, recency
from trunkwatch.operators.listing import defects_only, group_apart, with_object
from trunkwatch.operators.stats import objects_of_lines
from trunkwatch.schema import (
    ADVICE_ATTENTION, ADVICE_GOOD, ADVICE_REGULAR, ADVICE_REPAIR, MSG_HIGH, MSG_INSUFFICIENT,
    MSG_LOW, MSG_MEDIUM, MSG_NO_DEFECT, MSG_NO_DIAGNOSTICS, MSG_NO_OBJECTS, MSG_ONE_DEFECT)

HORIZON_DAYS = 365
MIN_INSPECTIONS = 3
HAS_LINE = "dated_defects >= 2"


def days_since_first_defect(diagnostics: DataFrame) -> DataFrame:
    """Every defect with the days since its object's first one.

    The first day per object is an aggregate joined back, not a window: a window
    would sort all defects of a hot object in one task.
    """
    defects = defects_only(diagnostics).withColumn("day", inspected_on())
    first = group_apart(defects, "object_id").agg(F.min("day").alias("first_day")).drop("shard")
    return (defects.join(first, "object_id")
            .select("diag_id", "object_id", F.date_diff("day", "first_day").alias("days_since_first")))


def last_defect_depth(diagnostics: DataFrame) -> DataFrame:
    depth = or_zero(F.col("param1"))
    return (defects_only(diagnostics).where(F.col("object_id").isNotNull())
            .groupBy("object_id")
            .agg(F.max_by(depth, recency(inspected_on(), F.col("diag_id"))).alias("current_depth")))


def in_last_year(day: Column, as_of: str) -> Column:
    return day > F.date_sub(F.lit(as_of).cast("date"), 365)


def inspection_profile(diagnostics: DataFrame, as_of: str | None = None) -> DataFrame:
    """Inspections, last day and defect-depth line of each object, in one aggregate.

    The line runs over days since 1970: its slope is the same for any origin, and
    it is evaluated relative to the mean day. On a single day the slope is 0.
    A defect without a usable date counts as a defect, but the line and the
    latest depth are those of the dated ones.
    With ``as_of`` the defects of the year before it are counted too.
    """
    rows = (diagnostics.where(F.col("object_id").isNotNull())
            .select("object_id", "diag_id", is_defect().alias("defect"), inspected_on().alias("day"),
                    or_zero(F.col("param1")).alias("depth")))
    dated = F.col("defect") & F.col("day").isNotNull()
    day = F.when(dated, F.col("day"))
    depth = F.when(dated, F.col("depth"))
    epoch_day = F.unix_date(day).cast("double")
    recent = [] if as_of is None else [F.count_if(in_last_year(day, as_of)).alias("recent")]
    folded = rows.groupBy("object_id").agg(
        *recent,
        F.count("*").alias("inspections"),
        F.max("day").alias("last_inspection"),
        F.count_if("defect").alias("defect_count"),
        F.count(day).alias("dated_defects"),
        F.max(day).alias("last_defect"),
        F.max_by(depth, recency(day, F.col("diag_id"))).alias("current_depth"),
        F.regr_slope(depth, epoch_day).alias("fitted"),
        F.avg(depth).alias("mean_depth"),
        F.avg(epoch_day).alias("mean_day"))
    slope = F.coalesce("fitted", F.lit(0.0))
    ahead = F.unix_date("last_defect") + HORIZON_DAYS - F.col("mean_day")
    return (folded.withColumn("slope", slope)
            .withColumn("predicted_depth", F.col("mean_depth") + F.col("slope") * ahead)
            .drop("fitted", "mean_depth", "mean_day", "last_defect"))


def trend_class(slope: Column) -> Column:
    return F.when(slope > 0.01, "increasing").when(slope < -0.01, "decreasing").otherwise("stable")


def _tier(predicted: Column, current: Column, high, medium, low) -> Column:
    return (F.when((predicted > 50) | (current > 40), high)
            .when((predicted > 30) | (current > 25), medium)
            .otherwise(low))


def risk_tier(predicted: Column, current: Column) -> dict[str, Column]:
    """Risk, days to the next inspection, its method and a message."""
    return {
        "risk_probability": _tier(predicted, current, 0.85, 0.65, 0.25),
        "days_ahead": _tier(predicted, current, 90, 180, 365),
        "recommended_method": _tier(predicted, current, "UZK", "UZK", "VIK"),
        "message": _tier(predicted, current, MSG_HIGH, MSG_MEDIUM, MSG_LOW),
    }


def depth_trend(diagnostics: DataFrame) -> DataFrame:
    """Fitted line of every object with two dated defects or more."""
    return (inspection_profile(diagnostics).where(HAS_LINE)
            .select("object_id", "defect_count",
                    rounded(F.col("slope"), 4).alias("slope"),
                    rounded(F.col("current_depth"), 2).alias("current_depth"),
                    rounded(F.col("predicted_depth"), 2).alias("predicted_depth"),
                    trend_class(F.col("slope")).alias("trend")))


def _forecast() -> dict[str, Column]:
    """Forecast columns over an inspection profile; the first branch that holds applies."""
    few = F.coalesce(F.col("inspections") < MIN_INSPECTIONS, F.lit(True))
    clean, single = F.col("defect_count") == 0, ~F.expr(HAS_LINE)
    tier = risk_tier(F.col("predicted_depth"), F.col("current_depth"))

    def branch(insufficient, no_defect, one_defect, fitted) -> Column:
        return (F.when(few, insufficient).when(clean, no_defect).when(single, one_defect)
                .otherwise(fitted))

    def fitted_only(value: Column) -> Column:
        return F.when(~few & ~clean & ~single, value)

    days = branch(None, 365, 180, tier["days_ahead"])
    return {
        "status": F.when(few, "insufficient_data").otherwise("success"),
        "message": branch(MSG_INSUFFICIENT, MSG_NO_DEFECT, MSG_ONE_DEFECT, tier["message"]),
        "next_inspection_date": F.date_format(F.date_add("last_inspection", days), "yyyy-MM-dd"),
        "risk_probability": branch(0.0, 0.05, 0.3, tier["risk_probability"]),
        "recommended_method": branch(None, "VIK", "UZK", tier["recommended_method"]),
        "trend": branch(None, "stable", "unknown", trend_class(F.col("slope"))),
        "current_depth": fitted_only(rounded(F.col("current_depth"), 2)),
        "predicted_depth": fitted_only(rounded(F.greatest(F.lit(0.0), "predicted_depth"), 2)),
        "slope": fitted_only(rounded(F.col("slope"), 4)),
        "defect_count": fitted_only(F.col("defect_count")),
        "last_inspection": fitted_only(F.date_format("last_inspection", "yyyy-MM-dd")),
    }


def _with_forecast(profiles: DataFrame, *keep: str) -> DataFrame:
    return profiles.select(*keep, *[value.alias(name) for name, value in _forecast().items()])


def object_forecast(objects: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Forecast for each object, inspected or not."""
    ids = objects.select("object_id").where(F.col("object_id").isNotNull()).distinct()
    return _with_forecast(ids.join(inspection_profile(diagnostics), "object_id", "left"), "object_id")


def _known_forecasts(objects: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Forecasts that succeeded, of objects that the table has. Only inspected
    objects can succeed, so the others need not be brought in."""
    known = inspection_profile(diagnostics).join(objects.select("object_id"), "object_id", "left_semi")
    return _with_forecast(known, "object_id").where(F.col("status") == "success")


def forecast_of(objects: DataFrame, diagnostics: DataFrame, object_id: int) -> DataFrame:
    """Forecast for one id, whether or not the object table knows it."""
    wanted = objects.sparkSession.range(1).select(F.lit(object_id).cast("long").alias("object_id"))
    history = inspection_profile(diagnostics.where(F.col("object_id") == object_id))
    forecast = _with_forecast(wanted.join(history, "object_id", "left"), "object_id")
    named = one_per_object(objects.where(F.col("object_id") == object_id),
                           "object_name", "object_type", "pipeline_id")
    return forecast.join(named, "object_id", "left")


def top_risks(objects: DataFrame, diagnostics: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` objects most at risk, ties by id."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must lie between 1 and 100")
    order = [F.desc("risk_probability"), F.asc("object_id")]
    top = _known_forecasts(objects, diagnostics).orderBy(*order).limit(limit)
    # Few rows by now: name them first and drop copies of an object afterwards.
    names = ["object_name", "object_type", "pipeline_id"]
    named = (with_object(top, objects, *names, how="inner")
             .groupBy(*top.columns).agg(F.min(F.struct(*names)).alias("named")))
    return (named.select("*", "named.*")
            .select("object_id", *names, "risk_probability", "next_inspection_date",
                    "recommended_method", "trend", "message",
                    F.coalesce("current_depth", F.lit(0.0)).alias("current_depth"),
                    F.coalesce("predicted_depth", F.lit(0.0)).alias("predicted_depth"))
            .orderBy(*order))


def top_risks_on_trunkline(objects: DataFrame, diagnostics: DataFrame, pipeline_id: str,
                           limit: int = 10) -> DataFrame:
    """Those of the overall top that lie on the line: the cut comes first, so this may be empty."""
    return top_risks(objects, diagnostics, limit).where(F.col("pipeline_id") == pipeline_id)


def critical_objects(objects: DataFrame, diagnostics: DataFrame, k: int = 10) -> DataFrame:
    """Up to ``k`` objects with risk above 0.6 of every line, most at risk first."""
    risky = (_with_forecast(inspection_profile(diagnostics), "object_id")
             .where((F.col("status") == "success") & (F.col("risk_probability") > 0.6))
             .select("object_id", F.col("risk_probability").alias("risk"),
                     F.col("next_inspection_date").alias("next_inspection")))
    order = Window.partitionBy("pipeline_id").orderBy(F.desc("risk"), F.asc("object_id"))
    return (objects.where(F.col("pipeline_id").isNotNull()).select("pipeline_id", "object_id")
            .join(risky, "object_id")
            .withColumn("position", F.row_number().over(order))
            .where(F.col("position") <= k))


def recent_defects(diagnostics: DataFrame, as_of: str) -> DataFrame:
    """Defects per object in the year up to ``as_of``."""
    return (defects_only(diagnostics).where(in_last_year(inspected_on(), as_of))
            .groupBy("object_id").agg(F.count("*").alias("recent")))


def grown(count: Column) -> Column:
    """A tenth more, fractions dropped."""
    return (count * F.lit(1.1)).cast("long")


def defects_last_year(objects: DataFrame, diagnostics: DataFrame, as_of: str) -> DataFrame:
    return (objects_of_lines(objects).join(recent_defects(diagnostics, as_of), "object_id", "left")
            .groupBy("pipeline_id")
            .agg(F.coalesce(F.sum("recent"), F.lit(0)).alias("defects_last_year"))
            .withColumn("predicted_defects_next_year", grown(F.col("defects_last_year"))))


def recommendation(share: Column, critical: Column) -> Column:
    return (F.when((share > 0.5) | (critical > 10), ADVICE_REPAIR)
            .when((share > 0.3) | (critical > 5), ADVICE_ATTENTION)
            .when(share > 0.15, ADVICE_REGULAR)
            .otherwise(ADVICE_GOOD))


def trunkline_forecast(pipelines: DataFrame, objects: DataFrame, diagnostics: DataFrame,
                       as_of: str) -> DataFrame:
    """Outlook of every line; those without objects or inspections get a status only.

    The profile of an object carries everything its line needs: diagnostics are
    read and shuffled once, and are one row per object before a join.
    """
    risk = _forecast()
    facts = inspection_profile(diagnostics, as_of).select(
        "object_id", "inspections", "defect_count", "recent",
        ((risk["status"] == "success") & (risk["risk_probability"] > 0.6)).alias("critical"))
    per_line = (objects_of_lines(objects).join(facts, "object_id", "left")
                .groupBy("pipeline_id")
                .agg(F.sum("copies").alias("total_objects"),
                     F.sum("inspections").alias("inspections"),
                     F.count_if(F.col("defect_count") > 0).alias("defect_objects"),
                     F.sum(F.when(F.col("critical"), F.col("copies")).otherwise(0)).alias("critical_objects_count"),
                     F.coalesce(F.sum("recent"), F.lit(0)).alias("defects_last_year")))
    share = F.col("defect_objects") / F.col("total_objects")
    ok = F.col("inspections").isNotNull()
    return (pipelines.select("pipeline_id", "name").join(per_line, "pipeline_id", "left")
            .select("pipeline_id", "name",
                    F.when(ok, "success").otherwise("error").alias("status"),
                    F.when(F.col("total_objects").isNull(), MSG_NO_OBJECTS)
                    .when(~ok, MSG_NO_DIAGNOSTICS).alias("message"),
                    F.when(ok, F.col("total_objects")).alias("total_objects"),
                    F.when(ok, rounded(share, 2)).alias("defect_rate"),
                    F.when(ok, F.col("critical_objects_count")).alias("critical_objects_count"),
                    F.when(ok, F.col("defects_last_year")).alias("defects_last_year"),
                    F.when(ok, grown(F.col("defects_last_year"))).alias("predicted_defects_next_year"),
                    F.when(ok, recommendation(share, F.col("critical_objects_count")))
                    .alias("recommendation")))


def forecast_dashboard_trunklines(pipelines: DataFrame, objects: DataFrame, diagnostics: DataFrame,
                                  as_of: str) -> DataFrame:
    return (trunkline_forecast(pipelines, objects, diagnostics, as_of)
            .where(F.col("status") == "success")
            .select("pipeline_id", F.col("name").alias("pipeline_name"),
                    F.col("critical_objects_count").alias("critical_count"), "defect_rate",
                    F.col("predicted_defects_next_year").alias("predicted_defects")))


def forecast_dashboard_summary(objects: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """High and medium risks among the top ten, and the number of all objects."""
    risk = F.col("risk_probability")
    top = (_known_forecasts(objects, diagnostics)
           .orderBy(F.desc("risk_probability"), F.asc("object_id")).limit(10))
    parts = top.agg(
        F.count_if(risk > 0.6).alias("high_risk_objects"),
        F.count_if((risk > 0.3) & (risk <= 0.6)).alias("medium_risk_objects")).unionByName(
            objects.agg(F.count("*").alias("total_analyzed")), allowMissingColumns=True)
    names = ["high_risk_objects", "medium_risk_objects", "total_analyzed"]
    return parts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
