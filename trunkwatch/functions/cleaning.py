"""Null, non-finite and date handling."""

from pyspark.sql import Column, DataFrame, functions as F, types as T


def finite(value: Column) -> Column:
    """``value``, or null where it is NaN or infinite."""
    infinite = F.abs(value) == F.lit(float("inf"))
    return F.when(~(F.isnan(value) | infinite), value)


def clean_non_finite(df: DataFrame) -> DataFrame:
    """NaN and infinities of every floating column to null."""
    floating = (T.DoubleType, T.FloatType)
    return df.select([
        finite(F.col(f.name)).alias(f.name) if isinstance(f.dataType, floating) else F.col(f.name)
        for f in df.schema.fields])


def absent(number: Column) -> Column:
    """True for null and NaN alike."""
    return number.isNull() | F.isnan(number)


def or_zero(number: Column) -> Column:
    """``number`` as a double, 0 where it is null or NaN."""
    number = number.cast("double")
    return F.when(absent(number), 0.0).otherwise(number)


def is_defect(flag: str = "defect_found") -> Column:
    return F.coalesce(F.col(flag), F.lit(False))


def inspected_on(date: str = "date") -> Column:
    """Inspection date; null where the text is no date."""
    return F.try_to_date(date)


def inspection_year(date: str = "date") -> Column:
    return F.year(inspected_on(date))


def rounded(value: Column, places: int) -> Column:
    """Half-even rounding of a fitted value. Its last bits depend on the order in
    which partial sums merge; they are dropped first, lest they decide a tie."""
    return F.bround(F.round(value, 10), places)


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` to two places, 0 for an empty whole."""
    share = F.try_divide(part.cast("double"), whole.cast("double")) * 100
    return F.coalesce(F.bround(share, 2), F.lit(0.0))
