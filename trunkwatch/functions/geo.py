"""Positions along a line."""

from pyspark.sql import Column


def along(start: Column, end: Column, ratio: Column) -> Column:
    """Coordinate at ``ratio`` of the way from ``start`` to ``end``."""
    return start + (end - start) * ratio
