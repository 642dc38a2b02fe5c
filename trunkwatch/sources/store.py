"""Stored tables as versioned folders, and the log that says which one counts.

A table is ``<root>/<table>/<version>``. A version comes into force by the log
row that names it, so readers see the old table or the new one, never half.

A log is a folder per day of writing, which files are only added to, and snapshots:
a snapshot is the fold of all days before the one in its name, and counts from the
moment it is complete. Readers take the newest and the days from its name on, so
what they read does not grow with the number of entries; folded days are deleted
once a snapshot holds them, and are not read if they are still there.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trunkwatch.schema import DIAGNOSTICS, IMPORT_LOG, OBJECTS, PIPELINES
from trunkwatch.sources.tables import complete

SCHEMAS = {"pipelines": PIPELINES, "objects": OBJECTS, "diagnostics": DIAGNOSTICS}
SUCCESS, FAILED, ERROR = "SUCCESS", "FAILED", "ERROR"


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    folder, files = _folder(spark, path)
    return files.exists(folder)


def removed(spark: SparkSession, path: str) -> None:
    folder, files = _folder(spark, path)
    files.delete(folder, True)


def _named(spark: SparkSession, path: str, key: str) -> list[str]:
    """The values of ``key=value`` folders below ``path``, in order."""
    folder, files = _folder(spark, path)
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(name.removeprefix(f"{key}=") for name in names if name.startswith(f"{key}="))


def _today() -> dt.date:
    return dt.datetime.now(dt.timezone.utc).date()


def append(df: DataFrame, path: str, schema: T.StructType, part: str | None = None) -> None:
    """Adds entries to the day's folder; with ``part``, a folder of its own there, which a repeated write replaces."""
    folder = f"{path.rstrip('/')}/day={_today()}" + (f"/{part}" if part else "/entries")
    complete(df, schema).write.mode("overwrite" if part else "append").parquet(folder)


def _snapshot(spark: SparkSession, path: str) -> str | None:
    """The name of the newest complete snapshot."""
    whole = [day for day in _named(spark, path, "upto") if exists(spark, f"{path.rstrip('/')}/upto={day}/_SUCCESS")]
    return whole[-1] if whole else None


def _entries(spark: SparkSession, path: str, schema: T.StructType, before: str | None = None) -> DataFrame:
    path, newest = path.rstrip("/"), _snapshot(spark, path)
    days = [day for day in _named(spark, path, "day") if (not newest or day >= newest) and (not before or day < before)]
    folders = [f"{path}/upto={newest}"] * bool(newest)
    for day in days:
        folders += [f"{path}/day={day}/entries"] * exists(spark, f"{path}/day={day}/entries")
        folders += [f"{path}/day={day}/batch_id={n}" for n in _named(spark, f"{path}/day={day}", "batch_id")]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All entries of a log: the newest snapshot and the days since."""
    return _entries(spark, path, schema)


def fold(spark: SparkSession, path: str, schema: T.StructType, folded: Callable[[DataFrame], DataFrame],
         upto: dt.date | None = None) -> None:
    """Writes a snapshot of all days before ``upto`` (yesterday) and deletes what it makes superfluous.

    ``folded`` may leave out entries that change nothing for readers; folding again
    what was folded must change nothing either. Entries that take more than a day to
    be written would be missed.
    """
    path, upto = path.rstrip("/"), str(upto or _today() - dt.timedelta(days=1))
    newest = _snapshot(spark, path)
    if newest and newest >= upto or not any(day < upto for day in _named(spark, path, "day")):
        return
    complete(folded(_entries(spark, path, schema, before=upto)), schema).write.mode("overwrite").parquet(f"{path}/upto={upto}")
    tidy(spark, path)


def tidy(spark: SparkSession, path: str) -> None:
    """Deletes the days that the newest snapshot holds, and older snapshots."""
    path, newest = path.rstrip("/"), _snapshot(spark, path)
    if newest:
        for key in ("day", "upto"):
            for day in _named(spark, path, key):
                if day < newest:
                    removed(spark, f"{path}/{key}={day}")


def version_path(root: str, table: str, version: str) -> str:
    return f"{root.rstrip('/')}/{table}/{version}"


def append_log(spark: SparkSession, root: str, row: dict) -> None:
    entry = tuple(row.get(name) for name in IMPORT_LOG.fieldNames())
    append(spark.createDataFrame([entry], IMPORT_LOG).coalesce(1), f"{root}/import_log", IMPORT_LOG)


def import_log(spark: SparkSession, root: str) -> DataFrame:
    """All runs, oldest first."""
    return read(spark, f"{root}/import_log", IMPORT_LOG).orderBy("timestamp", "run_id")


def fold_import_log(spark: SparkSession, root: str, upto: dt.date | None = None) -> None:
    """Puts the runs of past days into one snapshot; no run is left out."""
    fold(spark, f"{root}/import_log", IMPORT_LOG, lambda runs: runs.repartition(1), upto)


def current_version(spark: SparkSession, root: str, table: str) -> str | None:
    newest = (import_log(spark, root)
              .where((F.col("table_name") == table) & (F.col("status") == SUCCESS))
              .agg(F.max_by("version", F.struct("timestamp", "run_id")).alias("version")))
    return newest.first()["version"]


def current(spark: SparkSession, root: str, table: str, *also: str) -> DataFrame | None:
    """The table in force with its declared columns, and ``also`` some that only the store has, or ``None``
    before a first import."""
    version = current_version(spark, root, table)
    if version is None:
        return None
    stored = spark.read.parquet(version_path(root, table, version))
    wanted = T.StructType([*SCHEMAS[table].fields, *[f for f in stored.schema.fields if f.name in also]])
    return complete(stored, wanted)


def append_events(events: DataFrame, path: str, schema: T.StructType, part: str | None = None) -> None:
    """Adds alert events; what is there is never rewritten but by the same ``part``."""
    append(events, path, schema, part)


def read_events(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return read(spark, path, schema)


def first_events(events: DataFrame) -> DataFrame:
    """The events that decide the state of alerts: of each alert the first of every action, and each read-all."""
    once = F.when(F.col("action") == "read_all", F.col("event_at"))
    said = F.min_by(F.struct("message", "type", "metadata"), F.struct("event_at", "message", "type"))
    return (events.groupBy("alert_id", "action", once.alias("once")).agg(F.min("event_at").alias("event_at"), said.alias("said"))
            .select("alert_id", "action", "event_at", "said.*"))


def fold_events(spark: SparkSession, path: str, schema: T.StructType, upto: dt.date | None = None) -> None:
    """Puts the events of past days into one snapshot of those that decide."""
    fold(spark, path, schema, first_events, upto)
