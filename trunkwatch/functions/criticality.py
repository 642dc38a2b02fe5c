"""Criticality rules and classifier features."""

from pyspark.sql import Column, functions as F

from trunkwatch.functions.cleaning import is_defect, or_zero
from trunkwatch.schema import CRITICAL_METHODS, QUALITY_GRADES


def risk_label(depth: Column, erf: Column, grade: Column) -> Column:
    """Label from depth, repair factor and grade; an absent factor has no say."""
    depth, erf = or_zero(depth), or_zero(erf)
    grade = F.coalesce(grade, F.lit(""))
    *_, needs_measures, unacceptable = QUALITY_GRADES
    return (F.when((grade == unacceptable) | (depth > 50) | (erf > 0.7), "high")
            .when((grade == needs_measures) | (depth > 30) | (erf > 0.5), "medium")
            .otherwise("normal"))


def rule_label() -> Column:
    """Label by rule alone: rows without a defect are normal."""
    by_rule = risk_label(F.col("param1"), F.lit(None).cast("double"), F.col("quality_grade"))
    return F.when(is_defect(), by_rule).otherwise("normal")


def rule_confidence() -> Column:
    """Confidence in percent that goes with :func:`rule_label`."""
    label = rule_label()
    return (F.when(~is_defect(), 95.0)
            .when(label == "high", 90.0)
            .when(label == "medium", 80.0)
            .otherwise(70.0))


def quality_score(grade: Column) -> Column:
    """1 (best) to 4; unknown and null grades count as 1."""
    score = F.lit(1)
    for points, name in enumerate(QUALITY_GRADES, start=1):
        score = F.when(grade == name, points).otherwise(score)
    return score


def critical_method(method: Column) -> Column:
    return F.coalesce(method.isin(CRITICAL_METHODS), F.lit(False)).cast("int")


def area(p2: Column, p3: Column) -> Column:
    return F.when((p2 > 0) & (p3 > 0), p2 * p3).otherwise(0.0)


def geometry() -> dict[str, Column]:
    """Area, volume, depth to area and shape of a defect."""
    p1, p2, p3 = or_zero(F.col("param1")), or_zero(F.col("param2")), or_zero(F.col("param3"))
    surface = area(p2, p3)
    return {
        "defect_area": surface,
        "defect_volume": F.when((p1 > 0) & (p2 > 0) & (p3 > 0), p1 * p2 * p3).otherwise(0.0),
        "depth_to_area_ratio": F.when(surface > 0, p1 / (surface + 1)).otherwise(0.0),
        # try_divide: the untaken branch must not fail on a width of zero
        "shape_index": F.when(p3 > 0, F.try_divide(p2, p3)).otherwise(1.0),
    }


def conditions() -> dict[str, Column]:
    """Temperature, humidity and illumination on comparable scales."""
    return {
        "temp_normalized": (or_zero(F.col("temperature")) + 50) / 100,
        "humidity_normalized": or_zero(F.col("humidity")) / 100,
        "illumination_normalized": or_zero(F.col("illumination")) / 1000,
    }


def size_flags() -> dict[str, Column]:
    return {
        "is_deep_defect": (or_zero(F.col("param1")) > 30).cast("int"),
        "is_large_defect": (area(or_zero(F.col("param2")), or_zero(F.col("param3"))) > 10000).cast("int"),
    }


def features() -> dict[str, Column]:
    """All classifier inputs by name."""
    return {
        "param1": or_zero(F.col("param1")),
        "param2": or_zero(F.col("param2")),
        "param3": or_zero(F.col("param3")),
        "quality_score": quality_score(F.col("quality_grade")),
        "defect_found": is_defect().cast("int"),
        "is_critical_method": critical_method(F.col("method")),
        **geometry(), **conditions(), **size_flags(),
    }
