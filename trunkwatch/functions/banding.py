"""Bands and labels shown next to forecasts and alerts."""

from pyspark.sql import Column, functions as F

from trunkwatch.schema import (
    AGE_DAYS, AGE_HOURS, AGE_MINUTES, AGE_NOW, BAND_HIGH, BAND_LOW, BAND_MEDIUM,
    TREND_BETTER, TREND_STABLE, TREND_WORSE)


def risk_band(risk: Column) -> Column:
    return F.when(risk > 0.6, BAND_HIGH).when(risk > 0.3, BAND_MEDIUM).otherwise(BAND_LOW)


def trend_label(trend: Column) -> Column:
    return (F.when(trend == "increasing", TREND_WORSE)
            .when(trend == "decreasing", TREND_BETTER)
            .otherwise(TREND_STABLE))


def depth_flags(current: Column, predicted: Column) -> dict[str, Column]:
    return {
        "current_critical": F.coalesce(current > 30, F.lit(False)),
        "predicted_critical": F.coalesce(predicted > 50, F.lit(False)),
    }


def alert_age(created_at: Column, as_of: Column) -> Column:
    """Age in words, the date itself from a week on."""
    millis = F.timestamp_diff("MILLISECOND", created_at, as_of)
    minutes, hours, days = (F.floor(millis / n) for n in (60_000, 3_600_000, 86_400_000))
    return (F.when(minutes < 1, AGE_NOW)
            .when(minutes < 60, F.format_string(AGE_MINUTES, minutes))
            .when(hours < 24, F.format_string(AGE_HOURS, hours))
            .when(days < 7, F.format_string(AGE_DAYS, days))
            .otherwise(F.date_format(created_at, "dd.MM.yyyy")))
