"""Reading the given tables and writing intermediate ones."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trunkwatch.session import work_folder
from trunkwatch.sources.tables import named


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # tasks import this package, from wherever the driver was started
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Writes ``df`` below the cluster's shared folder and reads it back.

    Cuts the lineage: what follows does not depend on executors that are lost.
    """
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidied(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` on a task's batches, after which the worker gives back free memory.

    Workers outlive their tasks; what allocators hold back would add up over the
    stages of a job.
    """

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # there is no malloc_trim but in glibc
            ctypes.CDLL(None).malloc_trim(0)

    return run


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(named(column).cast("string"), F.lit(""))


def partitions(spark: SparkSession, n_bytes: int, each: int) -> int:
    """As many partitions as the session shuffles to, and more if they would exceed ``each`` bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // each))
