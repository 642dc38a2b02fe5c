"""Data-quality rules.

All rules of a table are counted in one pass. A row is counted once under its key
and once under the object it refers to, in one aggregate; the conditional counts of
the row rules ride on the latter. Keys that are counted twice are repeats, objects
that are not in the object table make orphans; a hot missing object costs one row
in that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trunkwatch.functions.cleaning import absent, inspected_on, is_defect
from trunkwatch.schema import (
    METHODS_AT_IMPORT, METHODS_AT_STARTUP, OBJECT_TYPES, QUALITY_GRADES, REQUIRED_AT_IMPORT,
    REQUIRED_AT_STARTUP, RISK_LABELS)

ERROR, WARNING = "error", "warning"


def missing_columns(columns: list[str], table: str, startup: bool = False) -> list[str]:
    """Required columns that are absent; names are case-sensitive."""
    required = (REQUIRED_AT_STARTUP if startup else REQUIRED_AT_IMPORT)[table]
    return [name for name in required if name not in columns]


def not_in(column: str, allowed: list[str]) -> Column:
    """True where the value is not one of ``allowed``; null is none of them."""
    return ~F.coalesce(F.col(column).isin(allowed), F.lit(False))


def bad_date(column: str = "date") -> Column:
    return F.col(column).isNotNull() & inspected_on(column).isNull()


def outside(column: str, low: float, high: float) -> Column:
    value = F.col(column)
    return ~absent(value) & ~value.between(low, high)


def object_row_rules() -> dict[str, tuple[str, Column]]:
    rules = {
        "unknown_object_type": (WARNING, not_in("object_type", OBJECT_TYPES)),
        "latitude_out_of_range": (ERROR, outside("lat", -90, 90)),
        "longitude_out_of_range": (ERROR, outside("lon", -180, 180)),
    }
    for name in REQUIRED_AT_IMPORT["objects"]:
        value = F.col(name)
        rules[f"null_{name}"] = (WARNING, absent(value) if name in ("lat", "lon") else value.isNull())
    return rules


def diagnostic_row_rules(columns: list[str]) -> dict[str, tuple[str, Column]]:
    rules = {
        "unknown_method": (WARNING, not_in("method", METHODS_AT_IMPORT)),
        "null_date": (WARNING, F.col("date").isNull()),
        "invalid_date": (WARNING, bad_date()),
    }
    if "quality_grade" in columns:
        rules["unknown_quality_grade"] = (WARNING, not_in("quality_grade", QUALITY_GRADES))
    if "ml_label" in columns:
        rules["unknown_ml_label"] = (WARNING, not_in("ml_label", RISK_LABELS))
    if "param1" in columns:
        rules["missing_param1"] = (WARNING, is_defect() & absent(F.col("param1")))
    return rules


def count_rules(df: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row: offending rows per rule."""
    return df.agg(*[F.count_if(bad).alias(name) for name, (_, bad) in rules.items()])


def count_repeats(df: DataFrame, key: str) -> DataFrame:
    """One row: occurrences of a key after its first."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(f"duplicate_{key}"))


def orphan_ids(diagnostics: DataFrame, objects: DataFrame) -> DataFrame:
    """Each object id that is missing from ``objects``, with its number of diagnostics."""
    per_id = diagnostics.groupBy("object_id").agg(F.count("*").alias("n_rows"))
    return per_id.join(objects.select("object_id"), "object_id", "left_anti")


def count_orphans(diagnostics: DataFrame, objects: DataFrame) -> DataFrame:
    found = orphan_ids(diagnostics, objects)
    return found.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("orphan_object_id"))


def count_empty(df: DataFrame) -> DataFrame:
    return df.agg((F.count("*") == 0).cast("long").alias("empty_table"))


def offending_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Every value outside the list, null included, with its number of rows."""
    return (df.where(not_in(column, allowed)).groupBy(F.col(column).alias("value"))
            .agg(F.count("*").alias("n_rows")))


def _first(values: DataFrame, k: int) -> DataFrame:
    """One row: the ``k`` smallest of ``value`` as text, comma-separated."""
    first = values.orderBy(F.asc_nulls_first("value")).limit(k)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("value"))),
                         lambda kept: F.coalesce(kept["value"].cast("string"), F.lit("null")))
    return first.agg(F.array_join(listed, ", ").alias("examples"))


def first_repeats(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The first ``k`` repeat occurrences of a key, in key order.

    A key stored n times repeats n-1 times; no more than ``k`` of them can be
    among the first ``k``.
    """
    repeats = (df.groupBy(F.col(key).alias("value")).agg(F.count("*").alias("n")).where("n > 1")
               .select("value", F.least(F.col("n") - 1, F.lit(k)).cast("int").alias("times")))
    return _first(repeats.select(F.explode(F.array_repeat("value", F.col("times"))).alias("value")), k)


def first_orphans(diagnostics: DataFrame, objects: DataFrame, k: int = 10) -> DataFrame:
    return _first(orphan_ids(diagnostics, objects).select(F.col("object_id").alias("value")), k)


def count_unreadable(df: DataFrame) -> DataFrame:
    """Values per column that could not be read as its type, of a marked batch."""
    return (df.select(F.explode("_unreadable").alias("column"))
            .groupBy("column").agg(F.count("*").alias("n_rows")))


def findings(parts: list[DataFrame], severities: dict[str, str]) -> DataFrame:
    """``(rule, severity, n_bad, is_valid)`` from one-row counts; only errors invalidate."""
    wide = parts[0]
    for part in parts[1:]:
        wide = wide.unionByName(part, allowMissingColumns=True)
    wide = wide.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in severities])
    errors = [F.col(name) for name, severity in severities.items() if severity == ERROR]
    is_valid = F.lit(True)
    for count in errors:
        is_valid = is_valid & (count == 0)
    cells = []
    for name, severity in severities.items():
        cells += [F.lit(name), F.lit(severity), F.col(name), is_valid]
    return wide.select(F.stack(F.lit(len(severities)), *cells)
                       .alias("rule", "severity", "n_bad", "is_valid"))


def _severities(rules: dict[str, tuple[str, Column]]) -> dict[str, str]:
    return {name: severity for name, (severity, _) in rules.items()}


def count_all(df: DataFrame, rules: dict[str, tuple[str, Column]], key: str | None = None,
              objects: DataFrame | None = None) -> DataFrame:
    """One row, from one reading of ``df``: offending rows per rule, repeats of ``key``, orphans and emptiness.

    ``objects`` is what ``object_id`` refers to; without it, or without a key, the
    rows that these count are left out.
    """
    flags = [bad.cast("long").alias(name) for name, (_, bad) in rules.items()]
    nothing = [F.lit(0).cast("long").alias(name) for name in rules]
    id_ = (F.col("object_id") if objects is not None else F.lit(None)).cast("long")
    views = [F.struct(F.lit("object").alias("kind"), id_.alias("id"), *flags)]
    if key:
        views.append(F.struct(F.lit("key").alias("kind"), F.col(key).cast("long").alias("id"), *nothing))
    counted = (df.select(F.inline(F.array(*views))).groupBy("kind", "id")
               .agg(F.count("*").alias("n"), *[F.sum(name).alias(name) for name in rules]))
    by_object = F.col("kind") == "object"
    counts = [F.sum(name).alias(name) for name in rules]
    counts.append((F.coalesce(F.sum(F.when(by_object, F.col("n"))), F.lit(0)) == 0).cast("long").alias("empty_table"))
    if key:
        counts.append(F.sum(F.when(~by_object, F.col("n") - 1)).alias(f"duplicate_{key}"))
    if objects is not None:
        known = (objects.groupBy(F.col("object_id").cast("long").alias("id")).agg(F.lit(True).alias("known"))
                 .withColumn("kind", F.lit("object")))
        counted = counted.join(known, ["kind", "id"], "left")
        counts.append(F.sum(F.when(by_object & F.col("known").isNull(), F.col("n"))).alias("orphan_object_id"))
    return counted.agg(*counts)


def validate_objects(objects: DataFrame) -> DataFrame:
    rules = object_row_rules()
    return findings([count_all(objects, rules, "object_id")],
                    {**_severities(rules), "duplicate_object_id": ERROR})


def validate_diagnostics(diagnostics: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """Import rules; the reference to objects is checked where there are any."""
    rules = diagnostic_row_rules(diagnostics.columns)
    severities = {**_severities(rules), "duplicate_diag_id": ERROR}
    if objects is not None:
        severities["orphan_object_id"] = ERROR
    return findings([count_all(diagnostics, rules, "diag_id", objects)], severities)


def validate_at_startup(objects: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """The stricter set applied to stored tables. It reports and does not block."""
    rules = {
        "unknown_method": (ERROR, not_in("method", METHODS_AT_STARTUP)),
        "invalid_date": (ERROR, bad_date()),
    }
    on_objects = findings(
        [count_all(objects, {}, "object_id")],
        {"duplicate_object_id": ERROR, "empty_table": ERROR})
    on_diagnostics = findings(
        [count_all(diagnostics, rules, objects=objects)],
        {**_severities(rules), "orphan_object_id": ERROR, "empty_table": ERROR})
    return (on_objects.withColumn("table_name", F.lit("objects"))
            .unionByName(on_diagnostics.withColumn("table_name", F.lit("diagnostics"))))
