"""Import of a batch: read, check, and put in force when no error was found."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from trunkwatch import schema as s
from trunkwatch.operators import listing, model, quality
from trunkwatch.sources import store
from trunkwatch.sources.tables import UNREADABLE, conform, preview, read_csv_any_charset
from trunkwatch.sources.workbooks import read_workbooks

_LISTS = {
    "unknown_object_type": (s.WARN_TYPES, "object_type", s.OBJECT_TYPES),
    "unknown_method": (s.WARN_METHODS, "method", s.METHODS_AT_IMPORT),
    "unknown_quality_grade": (s.WARN_GRADES, "quality_grade", s.QUALITY_GRADES),
    "unknown_ml_label": (s.WARN_LABELS, "ml_label", s.RISK_LABELS),
}
PREVIEW_ROWS = 10
#: Unknown values, and characters of them, that a warning itself lists; all are in the table of the run.
LISTED_VALUES, LISTED_CHARS = 100, 10_000

# Rows that are looked up together lie together: a lookup by object skips the
# other files, and an aggregate by object is nearly done before its shuffle.
# The second column lets a hot first value extend over several files. Diagnostics
# are a folder per year, so that a range of dates leaves whole folders unread.
_LAYOUT = {"objects": ["pipeline_id", "object_id"], "diagnostics": ["object_id", "date"]}


@dataclass
class ImportResult:
    """What a run did. Warnings name every unknown value, or the table that has them; a
    rejected batch stays at ``staged_path`` until :func:`discard`."""
    success: bool = False
    status: str = store.FAILED
    rows_imported: int = 0
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    preview: list[Row] = field(default_factory=list)
    staged_path: str | None = None


def read_batch(spark: SparkSession, path: str, table: str, fmt: str) -> DataFrame:
    wanted = store.SCHEMAS[table]
    if fmt == "csv":
        return conform(read_csv_any_charset(spark, path), wanted, mark=True)
    if fmt == "xlsx":
        return conform(read_workbooks(spark, path, wanted), wanted, mark=True)
    raise ValueError(f"unsupported format: {fmt}")


def laid_out(df: DataFrame, table: str) -> DataFrame:
    """The rows in the order they are stored in, diagnostics with their :func:`listing.date_part`."""
    by = [name for name in _LAYOUT[table] if name in df.columns]
    if table == "diagnostics" and "date" in df.columns:
        df, by = df.withColumn(listing.DATE_PART, listing.date_part()), [listing.DATE_PART, *by]
    return df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df


def write_laid_out(df: DataFrame, table: str, path: str) -> None:
    dealt = laid_out(df, table)
    parts = [listing.DATE_PART] if listing.DATE_PART in dealt.columns else []
    dealt.write.partitionBy(*parts).parquet(path)


def _examples(one_row: DataFrame) -> str:
    return one_row.first()["examples"]


def _list_message(df: DataFrame, rule: str, unknown: str) -> str:
    """All values go to a table, ``value, n_rows``; the message names them, or how many and where."""
    text, column, allowed = _LISTS[rule]
    path = f"{unknown}/{column}"
    found = quality.offending_values(df, column, allowed)
    found.write.parquet(path)
    found = df.sparkSession.read.schema(found.schema).parquet(path)
    n, n_chars = found.agg(F.count("*"), F.coalesce(F.sum(F.char_length("value")), F.lit(0))).first()
    if n > LISTED_VALUES or n_chars > LISTED_CHARS:
        return f"{text}: {n} ({path})"
    rows = found.orderBy("value").select("value").collect()  # LISTED_VALUES at most
    return f"{text}: [{', '.join('null' if value is None else value for value, in rows)}]"


def _message(rule: str, n_bad: int, df: DataFrame, objects: DataFrame | None, unknown: str) -> str:
    if rule in _LISTS:
        return _list_message(df, rule, unknown)
    if rule.startswith("duplicate_"):
        key = rule.removeprefix("duplicate_")
        return s.ERR_DUPLICATES % (key, _examples(quality.first_repeats(df, key)))
    if rule == "orphan_object_id":
        return s.ERR_ORPHANS % _examples(quality.first_orphans(df, objects))
    if rule == "null_date":
        return s.WARN_DATES % n_bad
    if rule.startswith("null_"):
        return s.WARN_NULLS % (rule.removeprefix("null_"), n_bad)
    return {"latitude_out_of_range": s.ERR_LATITUDE,
            "longitude_out_of_range": s.ERR_LONGITUDE,
            "missing_param1": s.WARN_DEPTH % n_bad}[rule]


def check(df: DataFrame, table: str, objects: DataFrame | None, unknown: str) -> tuple[list[str], list[str]]:
    """Errors and warnings of a batch; a missing column ends the check at once.

    Unknown values are written below the path ``unknown``, a table for each column.
    """
    missing = quality.missing_columns(df.columns, table)
    if missing:
        there = [name for name in df.columns if name != UNREADABLE]
        return [s.ERR_MISSING_COLUMNS % (", ".join(missing), ", ".join(there))], []
    found = (quality.validate_objects(df) if table == "objects"
             else quality.validate_diagnostics(df, objects))
    rows = found.where("n_bad > 0").orderBy("rule").collect()  # one row per rule
    severity = {r["rule"]: r["severity"] for r in rows}
    n_bad = {r["rule"]: r["n_bad"] for r in rows}
    if "invalid_date" in n_bad:  # told as one with the missing dates
        n_bad["null_date"] = n_bad.get("null_date", 0) + n_bad.pop("invalid_date")
        severity["null_date"] = severity["invalid_date"]
    messages = {rule: _message(rule, n, df, objects, unknown) for rule, n in sorted(n_bad.items())}
    errors = [m for rule, m in messages.items() if severity[rule] == quality.ERROR]
    warnings = [m for rule, m in messages.items() if severity[rule] == quality.WARNING]
    if UNREADABLE in df.columns:
        lost = quality.count_unreadable(df).orderBy("column").collect()  # one row per column
        warnings += [s.WARN_UNREADABLE % (r["column"], r["n_rows"]) for r in lost]
    return errors, warnings


def import_table(spark: SparkSession, path: str, root: str, table: str,
                 fmt: str = "csv") -> ImportResult:
    """Replaces a stored table by the batch at ``path`` unless the batch has errors.

    The batch is parsed once, into columnar files in the order of arrival. Checks
    read only the columns they need from there. Only a batch that passes is laid
    out by key, as the new version, which counts from the moment its row is in the
    log. A rejected one stays at ``staged_path`` for a look at what was wrong.
    """
    result = ImportResult()
    version = f"v-{uuid.uuid4().hex}"
    entry = {"run_id": version, "table_name": table, "file": path.rstrip("/").rsplit("/", 1)[-1]}
    try:
        result.staged_path = f"{root.rstrip('/')}/staging/{version}"
        read_batch(spark, path, table, fmt).write.parquet(result.staged_path)
        staged = spark.read.parquet(result.staged_path)
        result.preview = staged.drop(UNREADABLE).limit(PREVIEW_ROWS).collect()
        objects = store.current(spark, root, "objects") if table == "diagnostics" else None
        result.errors, result.warnings = check(staged, table, objects, f"{root.rstrip('/')}/import_unknown/{version}")
        if result.errors:
            entry |= {"errors": result.errors}
        else:
            write_laid_out(staged, table, store.version_path(root, table, version))
            result.success, result.status = True, store.SUCCESS
            result.rows_imported = staged.count()
            entry |= {"rows": result.rows_imported, "version": version}
    except Exception as error:  # whatever a file brings up ends in the log
        result.success, result.status, result.rows_imported = False, store.ERROR, 0
        result.errors.append(s.ERR_READ % error)
        entry |= {"errors": [str(error)], "version": None, "rows": None}
    entry |= {"status": result.status, "timestamp": dt.datetime.now(dt.timezone.utc)}
    store.append_log(spark, root, entry)
    if result.success:
        discard(spark, result)
    return result


def discard(spark: SparkSession, result: ImportResult) -> None:
    """Deletes the staged files of a run; they are no part of the store."""
    if result.staged_path:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(result.staged_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        result.staged_path = None


def import_objects(spark: SparkSession, path: str, root: str, fmt: str = "csv") -> ImportResult:
    return import_table(spark, path, root, "objects", fmt)


def import_diagnostics(spark: SparkSession, path: str, root: str, fmt: str = "csv") -> ImportResult:
    return import_table(spark, path, root, "diagnostics", fmt)


def import_and_train(spark: SparkSession, path: str, root: str,
                     fmt: str = "csv") -> tuple[ImportResult, model.Fit | None]:
    """Imports diagnostics and, when they came into force, fits the classifier anew."""
    result = import_diagnostics(spark, path, root, fmt)
    if not result.success:
        return result, None
    return result, model.train(store.current(spark, root, "diagnostics"))


def preview_batch(spark: SparkSession, path: str, table: str, fmt: str = "csv") -> DataFrame:
    return preview(read_batch(spark, path, table, fmt).drop(UNREADABLE))
