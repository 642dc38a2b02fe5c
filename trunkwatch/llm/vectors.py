"""Vectors of Arrow batches as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trunkwatch.sources.tables import named


def vector_column(name: str) -> Column:
    return named(name).cast("array<double>").alias("vector")


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, starts, flat): the rows with a vector of finite components, their lengths' bounds, all components.

    A row is left out if its vector is null or empty or holds a null or a component that is not finite.
    """
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    offsets -= offsets[0]
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    lengths = np.diff(offsets)
    whole = (bad[offsets[1:]] == bad[offsets[:-1]]) & (lengths > 0)
    if column.null_count:
        whole &= column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(whole)
    taken = np.repeat(whole, lengths)
    starts = np.concatenate([[0], np.cumsum(lengths[rows])])
    return rows, starts, flat[taken]


def of_length(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows whose vectors have ``length`` components, and these as a matrix."""
    rows, starts, flat = usable(column)
    fits = np.diff(starts) == length
    return rows[fits], flat[np.repeat(fits, np.diff(starts))].reshape(-1, length)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as a matrix."""
    n = len(column)
    offsets = column.offsets.to_numpy()
    flat = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def usual_length(vectors: DataFrame, vector: str) -> int:
    """The number of components that most vectors have, the larger of equally frequent ones; 0 without vectors."""
    sizes = vectors.select(F.size(named(vector)).alias("n")).where("n > 0").groupBy("n").count()
    most = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    return most["n"] if most else 0
