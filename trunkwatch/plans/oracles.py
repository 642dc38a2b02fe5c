"""The same queries as plain SQL over the whole tables, for DuckDB to run."""

from __future__ import annotations

from trunkwatch import schema as s
from trunkwatch.plans.catalog import AS_OF, LINE
from trunkwatch.sources.bridge import with_views

ORACLES: dict[str, str] = {}


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def oracle(key: str, views: tuple[str, ...], select: str, *ctes: str) -> None:
    ORACLES[key] = ",\n".join([with_views(*views), *ctes]) + "\n" + select


P, O, D, DD, OD, DN, E = (("pipelines",), ("objects",), ("diagnostics",), ("diagnostics_dirty",),
                          ("objects_dirty",), ("diagnostics_nonfinite",), ("alert_events",))

# --- sources and sinks -----------------------------------------------------------
oracle("scan_trunklines", P, "SELECT * FROM pipelines")
oracle("scan_objects", O, "SELECT * FROM objects")
oracle("scan_diagnostics", D, "SELECT * FROM diagnostics")
oracle("csv_charset_fallback", O, """
    SELECT * FROM objects UNION ALL SELECT * FROM objects UNION ALL
    SELECT * REPLACE (object_name || chr(152) || 'é' AS object_name, 'acier' AS material) FROM objects""")
oracle("clean_headers", O, "SELECT * FROM objects")
oracle("workbook_folder_ingest", O, "SELECT * FROM objects")
oracle("import_preview", O, """
    SELECT 'object_id, object_name, object_type, pipeline_id, lat, lon, year, material' AS columns,
           (SELECT count(*) FROM objects) AS row_count, *
    FROM objects ORDER BY object_id LIMIT 10""")
oracle("import_objects", O, "SELECT * FROM objects")
oracle("import_diagnostics", D, "SELECT * FROM diagnostics")
oracle("import_and_train", D, """
    SELECT 'SUCCESS' AS status, count(*) AS rows_imported, count(*) AS n_stored,
           count(*) FILTER (defect_found AND ml_label IS NOT NULL) >= 10 AS is_trained FROM diagnostics""")
_LOG = """log AS (
    SELECT 'objects' AS table_name, 'objects.csv' AS file, 'SUCCESS' AS status,
           (SELECT count(*) FROM objects) AS rows, 0 AS n_errors
    UNION ALL SELECT 'diagnostics', 'diagnostics.csv', 'FAILED', NULL, 2
    UNION ALL SELECT 'objects', 'missing.csv', 'ERROR', NULL, 1)"""
oracle("import_log", O, "SELECT * FROM log", _LOG)

# --- data quality ------------------------------------------------------------------


def _repeats(table: str, key: str) -> str:
    return f"""
    SELECT 'duplicate_{key}' AS rule,
           (SELECT cast(sum(n - 1) AS bigint) FROM (SELECT count(*) AS n FROM {table} GROUP BY {key})) AS n_bad,
           (SELECT string_agg(coalesce(cast(k AS varchar), 'null'), ', ' ORDER BY k NULLS FIRST)
            FROM (SELECT {key} AS k FROM (SELECT {key}, row_number() OVER (PARTITION BY {key}) AS r FROM {table})
                  WHERE r > 1 ORDER BY {key} NULLS FIRST LIMIT 5)) AS examples"""


def _offending(table: str, column: str, allowed: list[str], more: str = "") -> str:
    return f"""
    SELECT {column} AS value, count(*) AS n_rows{more} FROM {table}
    WHERE {column} IS NULL OR {column} NOT IN {_in(allowed)} GROUP BY {column}"""


def _rule(rule: str, severity: str, bad: str, table: str) -> str:
    return (f"SELECT '{rule}' AS rule, '{severity}' AS severity, "
            f"(SELECT count(*) FROM {table} WHERE {bad}) AS n_bad")


def _repeat_rule(table: str, key: str) -> str:
    return (f"SELECT 'duplicate_{key}' AS rule, 'error' AS severity, (SELECT cast(sum(n - 1) AS bigint) "
            f"FROM (SELECT count(*) AS n FROM {table} GROUP BY {key})) AS n_bad")


_BAD_DATE = "date IS NOT NULL AND try_cast(date AS date) IS NULL"
_ORPHAN = "object_id IS NULL OR object_id NOT IN (SELECT object_id FROM {} WHERE object_id IS NOT NULL)"
_LAT = _rule("latitude_out_of_range", "error", "lat NOT BETWEEN -90 AND 90", "objects_dirty")
_LON = _rule("longitude_out_of_range", "error", "lon NOT BETWEEN -180 AND 180", "objects_dirty")
_NULLS = [_rule(f"null_{c}", "warning", f"{c} IS NULL", "objects_dirty") for c in s.REQUIRED_AT_IMPORT["objects"]]
_DATES = [_rule("null_date", "warning", "date IS NULL", "diagnostics_dirty"),
          _rule("invalid_date", "warning", _BAD_DATE, "diagnostics_dirty")]
_DEPTH = _rule("missing_param1", "warning", "defect_found AND param1 IS NULL", "diagnostics_dirty")


def _unknown(rule: str, severity: str, column: str, allowed: list[str], table: str) -> str:
    return _rule(rule, severity, f"{column} IS NULL OR {column} NOT IN {_in(allowed)}", table)


def _all(rules: list[str]) -> str:
    return " UNION ALL ".join(rules)


def _judged(rules: list[str]) -> str:
    return (f"SELECT rule, severity, n_bad, count(*) FILTER (severity = 'error' AND n_bad > 0) OVER () = 0 "
            f"AS is_valid FROM ({_all(rules)})")


oracle("dq_duplicate_keys", OD + DD,
       _repeats("objects_dirty", "object_id") + " UNION ALL " + _repeats("diagnostics_dirty", "diag_id"))
oracle("dq_object_types", OD, _offending("objects_dirty", "object_type", s.OBJECT_TYPES))
oracle("dq_quality_grades", DD, _offending("diagnostics_dirty", "quality_grade", s.QUALITY_GRADES))
oracle("dq_risk_labels", DD, _offending("diagnostics_dirty", "ml_label", s.RISK_LABELS))
oracle("dq_methods", DD,
       _offending("diagnostics_dirty", "method", s.METHODS_AT_IMPORT, ", 'import' AS stage") + " UNION ALL "
       + _offending("diagnostics_dirty", "method", s.METHODS_AT_STARTUP, ", 'startup' AS stage"))
oracle("dq_coordinates", OD, _all([_LAT, _LON]))
oracle("dq_null_counts", OD, _all(_NULLS))
oracle("dq_dates", DD, _all(_DATES))
oracle("dq_missing_depth", DD, _DEPTH)
oracle("dq_orphans", DD + O, f"""
    SELECT object_id, count(*) AS n_rows FROM diagnostics_dirty
    WHERE {_ORPHAN.format('objects')} GROUP BY object_id""")
oracle("dq_empty", O + D, """
    SELECT 'objects' AS table_name, cast(count(*) = 0 AS bigint) AS empty_table FROM objects
    UNION ALL SELECT 'diagnostics', cast(count(*) = 0 AS bigint) FROM diagnostics""")
oracle("validate_objects", OD, _judged([
    _unknown("unknown_object_type", "warning", "object_type", s.OBJECT_TYPES, "objects_dirty"),
    _LAT, _LON, *_NULLS, _repeat_rule("objects_dirty", "object_id")]))
oracle("validate_diagnostics", DD + O, _judged([
    _unknown("unknown_method", "warning", "method", s.METHODS_AT_IMPORT, "diagnostics_dirty"), *_DATES,
    _unknown("unknown_quality_grade", "warning", "quality_grade", s.QUALITY_GRADES, "diagnostics_dirty"),
    _unknown("unknown_ml_label", "warning", "ml_label", s.RISK_LABELS, "diagnostics_dirty"), _DEPTH,
    _repeat_rule("diagnostics_dirty", "diag_id"),
    _rule("orphan_object_id", "error", _ORPHAN.format("objects"), "diagnostics_dirty")]))
_EMPTY = "SELECT 'empty_table' AS rule, 'error' AS severity, (SELECT cast(count(*) = 0 AS bigint) FROM {}) AS n_bad"
oracle("startup_validation", DD + OD,
       "SELECT *, 'objects' AS table_name FROM (" + _judged([
           _repeat_rule("objects_dirty", "object_id"), _EMPTY.format("objects_dirty")]) + ") UNION ALL "
       + "SELECT *, 'diagnostics' AS table_name FROM (" + _judged([
           _unknown("unknown_method", "error", "method", s.METHODS_AT_STARTUP, "diagnostics_dirty"),
           _rule("invalid_date", "error", _BAD_DATE, "diagnostics_dirty"),
           _rule("orphan_object_id", "error", _ORPHAN.format("objects_dirty"), "diagnostics_dirty"),
           _EMPTY.format("diagnostics_dirty")]) + ")")

# --- listings and joins ------------------------------------------------------------------
_ON_LINE = f"object_id IN (SELECT object_id FROM objects WHERE pipeline_id = '{LINE}')"
oracle("list_trunklines", P, "SELECT * FROM pipelines")
oracle("list_objects", O, f"SELECT * FROM objects WHERE pipeline_id = '{LINE}' AND object_type = 'crane'")
oracle("object_profile", O, "SELECT * FROM objects WHERE object_id = 7")
oracle("object_profiles", O, "SELECT * FROM objects")
oracle("list_diagnostics", D + O, """
    SELECT d.*, object_name, lat, lon, pipeline_id
    FROM (SELECT * FROM diagnostics
          WHERE defect_found AND date >= '1996-01-01' AND date <= '2000-12-31'
          ORDER BY date DESC, diag_id LIMIT 1000) d LEFT JOIN objects USING (object_id)""")
oracle("filter_date_range", D, "SELECT * FROM diagnostics WHERE date BETWEEN '1997-01-01' AND '1998-12-31'")
oracle("clean_non_finite", DN, """
    SELECT diag_id, object_id, method, date,
           CASE WHEN isfinite(temperature) THEN temperature END AS temperature,
           CASE WHEN isfinite(humidity) THEN humidity END AS humidity,
           CASE WHEN isfinite(param1) THEN param1 END AS param1
    FROM diagnostics_nonfinite""")
oracle("defects_only", D, "SELECT * FROM diagnostics WHERE defect_found")
oracle("high_risk_only", D, "SELECT * FROM diagnostics WHERE ml_label = 'high'")
oracle("diagnostics_of_trunkline", D + O, f"SELECT * FROM diagnostics WHERE {_ON_LINE}")
oracle("orphan_diagnostics", DD + O, f"SELECT * FROM diagnostics_dirty WHERE {_ORPHAN.format('objects')}")
oracle("enrich_left", DD + O, """
    SELECT d.*, object_name, lat, lon, pipeline_id FROM diagnostics_dirty d LEFT JOIN objects USING (object_id)""")


def _top(source: str, k: int, columns: str, count_name: str = "count") -> str:
    return f"""
    SELECT t.object_id, t.n AS {count_name}, {columns}
    FROM (SELECT object_id, count(*) AS n FROM {source} AND object_id IS NOT NULL GROUP BY object_id
          ORDER BY n DESC, object_id LIMIT {k}) t JOIN objects o USING (object_id)"""


oracle("enrich_topk_inner", DD + O, _top("diagnostics_dirty WHERE true", 100, "object_name, pipeline_id"))

# --- aggregates ------------------------------------------------------------------------------
_DEFECTS = "count(*) FILTER (defect_found)"
_HIGH = "count(*) FILTER (ml_label = 'high')"
_RATE = "coalesce(round_even(total_defects::double / nullif(total_inspections, 0)::double * 100, 2), 0)"
oracle("dashboard_summary", O + D, f"""
    SELECT *, {_RATE} AS defect_rate
    FROM (SELECT (SELECT count(*) FROM objects) AS total_objects, count(*) AS total_inspections,
                 {_DEFECTS} AS total_defects FROM diagnostics)""")


def _counts(column: str, where: str) -> str:
    return f"SELECT {column}, count(*) AS count FROM diagnostics WHERE {where} AND {column} IS NOT NULL GROUP BY 1"


oracle("method_distribution", D, _counts("method", "true"))
oracle("risk_distribution", D, _counts("ml_label", "true"))
oracle("quality_distribution", D, _counts("quality_grade", "defect_found"))
oracle("top_defect_objects", D + O, _top("diagnostics WHERE defect_found", 5, "object_name, pipeline_id"))
oracle("top_risk_objects", D + O, _top("diagnostics WHERE ml_label = 'high'", 5, "object_name, pipeline_id"))
oracle("yearly_trend", D, f"""
    SELECT cast(year(cast(date AS date)) AS int) AS year, count(*) AS inspections, {_DEFECTS} AS defects
    FROM diagnostics GROUP BY 1""")
oracle("trunkline_stats", P + O + D, """
    SELECT p.pipeline_id, p.name, count(DISTINCT o.object_id) AS objects_count,
           count(d.diag_id) AS inspections_count, count(*) FILTER (d.defect_found) AS defects_count,
           count(*) FILTER (d.ml_label = 'high') AS high_risk_count,
           count(*) FILTER (d.ml_label = 'high') > 0 AS needs_attention
    FROM pipelines p LEFT JOIN objects o USING (pipeline_id) LEFT JOIN diagnostics d USING (object_id)
    GROUP BY p.pipeline_id, p.name""")
oracle("object_history", D, f"""
    SELECT object_id, cast(year(cast(date AS date)) AS int) AS year, count(*) AS total_inspections,
           {_DEFECTS} AS defects_found, {_HIGH} AS high_risk FROM diagnostics GROUP BY 1, 2""")
oracle("object_totals", O + D, """
    SELECT o.object_id, count(d.diag_id) AS total_inspections, count(*) FILTER (d.defect_found) AS defects_count
    FROM objects o LEFT JOIN diagnostics d USING (object_id) GROUP BY o.object_id""")


def _summary(where: str) -> str:
    return f"""
    SELECT *, {_RATE} AS defect_rate
    FROM (SELECT count(*) AS total_inspections, {_DEFECTS} AS total_defects,
                 count(*) FILTER (ml_label = 'normal') AS risk_normal,
                 count(*) FILTER (ml_label = 'medium') AS risk_medium, {_HIGH} AS risk_high
          FROM diagnostics WHERE {where})"""


oracle("report_summary", D, _summary("true"))
oracle("report_summary_trunkline", D + O, _summary(_ON_LINE))
oracle("report_methods", D + O, _counts("method", _ON_LINE))
oracle("trunkline_polylines", P + O,
       "SELECT pipeline_id, name, object_id, lat, lon FROM pipelines JOIN objects USING (pipeline_id)")
oracle("defect_object_share", O + D, """
    SELECT *, defect_objects::double / total_objects AS defect_share
    FROM (SELECT pipeline_id, count(*) AS total_objects,
                 count(*) FILTER (object_id IN (SELECT object_id FROM diagnostics WHERE defect_found)) AS defect_objects
          FROM objects GROUP BY pipeline_id)""")
_LAST_YEAR = f"""last_year AS (
    SELECT pipeline_id, count(d.diag_id) AS n FROM objects o
    LEFT JOIN (SELECT * FROM diagnostics WHERE defect_found
               AND cast(date AS date) > DATE '{AS_OF}' - INTERVAL 365 DAY) d USING (object_id)
    GROUP BY pipeline_id)"""
_GROWN = "cast(floor(n * 1.1::double) AS bigint)"
oracle("defects_last_year", O + D, f"""
    SELECT pipeline_id, n AS defects_last_year, {_GROWN} AS predicted_defects_next_year FROM last_year""", _LAST_YEAR)

# --- latest, sorted, top-k -----------------------------------------------------------------------


def _latest(where: str) -> str:
    return f"""latest AS (SELECT * FROM diagnostics WHERE {where}
    QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY date DESC, diag_id DESC) = 1)"""


_POINT = ("object_id, object_name, object_type, pipeline_id, coalesce(lat, 0) AS lat, coalesce(lon, 0) AS lon, "
          "ml_label, method, date, defect_description, quality_grade")
oracle("latest_inspection_per_object", D, "SELECT * FROM latest", _latest("true"))
oracle("map_points", D + O, f"SELECT {_POINT} FROM latest LEFT JOIN objects USING (object_id)",
       _latest("defect_found"))
oracle("map_points_filtered", D + O,
       f"SELECT {_POINT} FROM latest JOIN objects USING (object_id) WHERE pipeline_id = '{LINE}'",
       _latest("method = 'UZK' AND date BETWEEN '1996-01-01' AND '2000-12-31'"))
oracle("days_since_first_defect", D, """
    SELECT diag_id, object_id, cast(datediff('day', min(cast(date AS date)) OVER (PARTITION BY object_id),
                                             cast(date AS date)) AS int) AS days_since_first
    FROM diagnostics WHERE defect_found""")
oracle("last_defect_depth", D, """
    SELECT object_id, coalesce(param1, 0) AS current_depth FROM diagnostics WHERE defect_found
    QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY date DESC, diag_id DESC) = 1""")
oracle("object_diagnostics_sorted", D,
       "SELECT * FROM diagnostics ORDER BY object_id, coalesce(param1, 0) DESC, diag_id")
oracle("report_high_risk_top20", D + O, """
    SELECT d.*, object_name, pipeline_id FROM diagnostics d LEFT JOIN objects USING (object_id)
    WHERE ml_label = 'high' ORDER BY date DESC, diag_id LIMIT 20""")
oracle("report_top10_objects", D + O,
       _top("diagnostics WHERE defect_found", 10, "object_name, object_type, pipeline_id", "defect_count"))

# --- scalar expressions ------------------------------------------------------------------------------
oracle("risk_label_rule", D, """
    SELECT diag_id, CASE WHEN quality_grade = 'недопустимо' OR coalesce(param1, 0) > 50 OR erf > 0.7::double THEN 'high'
                         WHEN quality_grade = 'требует_мер' OR coalesce(param1, 0) > 30 OR erf > 0.5::double THEN 'medium'
                         ELSE 'normal' END AS label
    FROM (SELECT *, CASE WHEN diag_id % 2 = 0 THEN humidity / 100 ELSE 0 END AS erf FROM diagnostics)""")
oracle("rule_based_class", D, """
    SELECT diag_id, ml_label, CASE WHEN NOT defect_found THEN 95.0 WHEN ml_label = 'high' THEN 90.0
                                   WHEN ml_label = 'medium' THEN 80.0 ELSE 70.0 END::double AS confidence
    FROM (SELECT diag_id, defect_found,
                 CASE WHEN NOT defect_found THEN 'normal'
                      WHEN quality_grade = 'недопустимо' OR param1 > 50 THEN 'high'
                      WHEN quality_grade = 'требует_мер' OR param1 > 30 THEN 'medium'
                      ELSE 'normal' END AS ml_label FROM diagnostics)""")
oracle("untrained_scores", D, """
    SELECT diag_id, CASE WHEN NOT defect_found THEN 'normal'
                         WHEN quality_grade = 'недопустимо' OR param1 > 50 THEN 'high'
                         WHEN quality_grade = 'требует_мер' OR param1 > 30 THEN 'medium'
                         ELSE 'normal' END AS ml_label,
           100.0::double AS confidence, 'rule_based' AS model_type, 1.0::double AS probability FROM diagnostics""")
_SCORE = ("CASE quality_grade WHEN 'допустимо' THEN 2 WHEN 'требует_мер' THEN 3 "
          "WHEN 'недопустимо' THEN 4 ELSE 1 END")
_CRITICAL = f"CASE WHEN method IN {_in(s.CRITICAL_METHODS)} THEN 1 ELSE 0 END"
oracle("quality_score", D, f"SELECT diag_id, {_SCORE} AS score FROM diagnostics")
oracle("critical_method_flag", DD, f"SELECT diag_id, method, {_CRITICAL} AS critical FROM diagnostics_dirty")
_FILLED = """filled AS (
    SELECT *, CASE WHEN p2 > 0 AND p3 > 0 THEN p2 * p3 ELSE 0 END AS defect_area
    FROM (SELECT * EXCLUDE (param1, param2, param3),
                 coalesce(param1, 0) AS p1, coalesce(param2, 0) AS p2, coalesce(param3, 0) AS p3,
                 coalesce(temperature, 0) AS t, coalesce(humidity, 0) AS h, coalesce(illumination, 0) AS i
          FROM diagnostics))"""
_VOLUME = "CASE WHEN p1 > 0 AND p2 > 0 AND p3 > 0 THEN p1 * p2 * p3 ELSE 0 END"
_RATIO = "CASE WHEN defect_area > 0 THEN p1 / (defect_area + 1) ELSE 0 END"
_SHAPE = "CASE WHEN p3 > 0 THEN p2 / p3 ELSE 1 END"
oracle("defect_geometry", D, f"""
    SELECT diag_id, defect_area, {_VOLUME} AS defect_volume, {_RATIO} AS depth_to_area_ratio,
           {_SHAPE} AS shape_index FROM filled""", _FILLED)
_NORMS = "(t + 50) / 100 AS temp_normalized, h / 100 AS humidity_normalized, i / 1000 AS illumination_normalized"
oracle("condition_norms", D, f"SELECT diag_id, {_NORMS} FROM filled", _FILLED)
oracle("size_flags", D, """
    SELECT diag_id, cast(p1 > 30 AS int) AS is_deep_defect, cast(defect_area > 10000 AS int) AS is_large_defect
    FROM filled""", _FILLED)
oracle("inspection_year", DD,
       "SELECT diag_id, date, cast(year(try_cast(date AS date)) AS int) AS year FROM diagnostics_dirty")


def _latin(value: str) -> str:
    for letter, latin in s.LATIN.items():
        value = f"replace({value}, '{letter}', '{latin}')"
    return value


oracle("transliterate", O,
       f"SELECT object_id, {_latin('material')} AS material, {_latin('object_name')} AS object_name FROM objects")
oracle("report_text_cuts", DD + OD, f"""
    SELECT diag_id, left(coalesce(date, '-'), 10) AS date,
           left(coalesce({_latin('object_name')}, '-'), 35) AS object, coalesce(method, '-') AS method,
           left(coalesce({_latin('quality_grade')}, '-'), 45) AS description
    FROM diagnostics_dirty LEFT JOIN objects_dirty USING (object_id) WHERE defect_found""")
oracle("report_object_names", OD, f"""
    SELECT object_id, left(coalesce({_latin('object_name')}, '-'), 40) AS object,
           CASE object_type WHEN 'crane' THEN 'Crane' WHEN 'compressor' THEN 'Compressor'
                WHEN 'pipeline_section' THEN 'Pipeline Section' ELSE coalesce(object_type, '-') END AS type,
           coalesce(pipeline_id, '-') AS pipeline
    FROM objects_dirty""")
oracle("locate_on_trunkline", O, """
    SELECT object_id, pipeline_id, start_lat + (end_lat - start_lat) * ratio AS lat,
           start_lon + (end_lon - start_lon) * ratio AS lon
    FROM (SELECT o.*, e.* EXCLUDE (pipeline_id),
                 coalesce((object_id - first_id)::double / nullif(last_id - first_id, 0), 0) AS ratio
          FROM objects o JOIN (
            SELECT pipeline_id, min(object_id) AS first_id, max(object_id) AS last_id,
                   arg_min(lat, object_id) AS start_lat, arg_min(lon, object_id) AS start_lon,
                   arg_max(lat, object_id) AS end_lat, arg_max(lon, object_id) AS end_lon
            FROM objects GROUP BY pipeline_id) e USING (pipeline_id))""")

# --- classifier ------------------------------------------------------------------------------------------
_FEATURES = f"""
    SELECT diag_id, p1 AS param1, p2 AS param2, p3 AS param3, {_SCORE}::double AS quality_score,
           defect_found::int::double AS defect_found, defect_area, {_VOLUME} AS defect_volume,
           {_CRITICAL}::double AS is_critical_method, {_NORMS}, {_RATIO} AS depth_to_area_ratio,
           {_SHAPE} AS shape_index, (p1 > 30)::int::double AS is_deep_defect,
           (defect_area > 10000)::int::double AS is_large_defect FROM filled"""
oracle("defect_features", D, _FEATURES, _FILLED)
oracle("class_weights", D, """
    SELECT ml_label, n, cast(sum(n) OVER () AS double) / (count(*) OVER () * n)::double AS weight
    FROM (SELECT ml_label, count(*) AS n FROM diagnostics WHERE defect_found GROUP BY ml_label)""")
oracle("train_model", D, """
    SELECT count(*) AS n_samples, string_agg(DISTINCT ml_label, ',' ORDER BY ml_label) AS classes,
           count(*) >= 10 AS is_trained FROM diagnostics WHERE defect_found""")
oracle("accuracy_check", D, """
    SELECT count(*) AS n_samples, true AS train_in_band, true AS test_in_band
    FROM diagnostics WHERE defect_found AND ml_label IS NOT NULL""")
oracle("score_check", D, """
    SELECT count(*) AS n_rows, count(DISTINCT diag_id) AS n_ids, 0::bigint AS n_not_likeliest,
           0::bigint AS n_not_whole, 0::bigint AS n_wrong_confidence, 0::bigint AS n_by_rule FROM diagnostics""")
oracle("importance_check", D, f"""
    SELECT string_agg(f, ',' ORDER BY f) AS features, true AS sums_to_one, 0::bigint AS n_negative
    FROM features""", "features AS (SELECT unnest([" + ", ".join(f"'{f}'" for f in s.FEATURES) + "]) AS f)")
oracle("training_alert_check", D, f"""
    SELECT 1::bigint AS n_alerts, 1::bigint AS n_success, count(*)::int AS features_count, 0::bigint AS n_wrong_accuracy
    FROM features""", "features AS (SELECT unnest([" + ", ".join(f"'{f}'" for f in s.FEATURES) + "]) AS f)")

# --- forecast ---------------------------------------------------------------------------------------------
_HISTORY = """history AS (
    SELECT object_id, count(*) AS inspections, max(cast(date AS date)) AS last_day,
           count(*) FILTER (defect_found) AS n, count(*) FILTER (defect_found AND cast(date AS date) IS NOT NULL) AS dated
    FROM diagnostics GROUP BY object_id)""".replace("cast(date AS date)", "try_cast(date AS date)")
_FIT = """points AS (
    SELECT object_id, diag_id, cast(date AS date) AS d, coalesce(param1, 0) AS depth,
           datediff('day', min(cast(date AS date)) OVER (PARTITION BY object_id), cast(date AS date))::double AS x
    FROM diagnostics WHERE defect_found AND cast(date AS date) IS NOT NULL),
defects AS (SELECT object_id, count(*) AS all_defects FROM diagnostics WHERE defect_found GROUP BY object_id),
fit AS (
    SELECT object_id, slope, intercept + slope * (last_x + 365) AS predicted, current_depth, all_defects AS n
    FROM (SELECT object_id, count(*) AS n, max(x) AS last_x,
                 CASE WHEN var_pop(x) = 0 THEN 0 ELSE regr_slope(depth, x) END AS slope,
                 CASE WHEN var_pop(x) = 0 THEN avg(depth) ELSE regr_intercept(depth, x) END AS intercept
          FROM points GROUP BY object_id)
    JOIN (SELECT object_id, depth AS current_depth FROM points
          QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY d DESC, diag_id DESC) = 1) USING (object_id)
    JOIN defects USING (object_id)
    WHERE n >= 2)""".replace("cast(date AS date)", "try_cast(date AS date)")


def _tier(high, medium, low) -> str:
    return (f"CASE WHEN predicted > 50 OR current_depth > 40 THEN {high} "
            f"WHEN predicted > 30 OR current_depth > 25 THEN {medium} ELSE {low} END")


def _branch(few, clean, single, fitted) -> str:
    return (f"CASE WHEN coalesce(inspections, 0) < 3 THEN {few} WHEN h.n = 0 THEN {clean} "
            f"WHEN h.dated < 2 THEN {single} ELSE {fitted} END")


def _places(value: str, digits: int) -> str:
    return f"round_even(round({value}, 10), {digits}) + 0.0"


_TREND = "CASE WHEN slope > 0.01::double THEN 'increasing' WHEN slope < -0.01::double THEN 'decreasing' ELSE 'stable' END"
_DAYS = _branch("NULL", 365, 180, _tier(90, 180, 365))
_FORECAST = f"""forecast AS (
    SELECT o.object_id, o.object_name, o.object_type, o.pipeline_id,
           CASE WHEN coalesce(inspections, 0) < 3 THEN 'insufficient_data' ELSE 'success' END AS status,
           {_branch(f"'{s.MSG_INSUFFICIENT}'", f"'{s.MSG_NO_DEFECT}'", f"'{s.MSG_ONE_DEFECT}'",
                    _tier(f"'{s.MSG_HIGH}'", f"'{s.MSG_MEDIUM}'", f"'{s.MSG_LOW}'"))} AS message,
           strftime(last_day + {_DAYS}, '%Y-%m-%d') AS next_inspection_date,
           {_branch(0.0, 0.05, 0.3, _tier(0.85, 0.65, 0.25))}::double AS risk_probability,
           {_branch("NULL", "'VIK'", "'UZK'", _tier("'UZK'", "'UZK'", "'VIK'"))} AS recommended_method,
           {_branch("NULL", "'stable'", "'unknown'", _TREND)} AS trend,
           {_branch("NULL", "NULL", "NULL", _places("current_depth", 2))} AS current_depth,
           {_branch("NULL", "NULL", "NULL", _places("greatest(0, predicted)", 2))} AS predicted_depth,
           {_branch("NULL", "NULL", "NULL", _places("slope", 4))} AS slope,
           {_branch("NULL", "NULL", "NULL", "h.n")} AS defect_count,
           {_branch("NULL", "NULL", "NULL", "strftime(last_day, '%Y-%m-%d')")} AS last_inspection
    FROM objects o LEFT JOIN history h USING (object_id) LEFT JOIN fit f USING (object_id))"""
_F = (_HISTORY, _FIT, _FORECAST)

_LINES = f"""
    SELECT object_id, n AS defect_count, {_places('slope', 4)} AS slope, {_places('current_depth', 2)} AS current_depth,
           {_places('predicted', 2)} AS predicted_depth, {_TREND} AS trend FROM fit"""
oracle("depth_trend", D, _LINES, _FIT)
oracle("depth_trend_dirty", DD, _LINES, _FIT.replace("FROM diagnostics", "FROM diagnostics_dirty"))
oracle("risk_tier", D, f"""
    SELECT object_id, {_tier(0.85, 0.65, 0.25)}::double AS risk_probability, {_tier(90, 180, 365)} AS days_ahead,
           {_tier("'UZK'", "'UZK'", "'VIK'")} AS recommended_method,
           {_tier(f"'{s.MSG_HIGH}'", f"'{s.MSG_MEDIUM}'", f"'{s.MSG_LOW}'")} AS message FROM fit""", _FIT)
oracle("object_forecast", O + D,
       "SELECT * EXCLUDE (object_name, object_type, pipeline_id) FROM forecast", *_F)
oracle("object_forecast_dirty", O + DD, "SELECT * EXCLUDE (object_name, object_type, pipeline_id) FROM forecast",
       *[part.replace("FROM diagnostics", "FROM diagnostics_dirty") for part in _F])
oracle("trend_class", O + D,
       "SELECT trend, count(*) AS objects FROM forecast WHERE trend IS NOT NULL GROUP BY trend", *_F)
oracle("next_inspection_date", O + D, "SELECT object_id, next_inspection_date FROM forecast", *_F)


def _top_risks(k: int) -> str:
    return f"""
    SELECT object_id, object_name, object_type, pipeline_id, risk_probability, next_inspection_date,
           recommended_method, trend, message, coalesce(current_depth, 0) AS current_depth,
           coalesce(predicted_depth, 0) AS predicted_depth
    FROM forecast WHERE status = 'success' ORDER BY risk_probability DESC, object_id LIMIT {k}"""


oracle("top_risks", O + D, _top_risks(20), *_F)
oracle("top_risks_by_trunkline", O + D, f"SELECT * FROM ({_top_risks(100)}) WHERE pipeline_id = '{LINE}'", *_F)
oracle("critical_objects", O + D, """
    SELECT pipeline_id, object_id, risk_probability AS risk, next_inspection_date AS next_inspection,
           cast(row_number() OVER (PARTITION BY pipeline_id ORDER BY risk_probability DESC, object_id) AS int) AS position
    FROM forecast WHERE status = 'success' AND risk_probability > 0.6
    QUALIFY row_number() OVER (PARTITION BY pipeline_id ORDER BY risk_probability DESC, object_id) <= 10""", *_F)
_OUTLOOK = f"""outlook AS (
    SELECT p.pipeline_id, p.name, total_objects, n, critical_objects_count,
           defect_objects::double / total_objects AS share,
           total_objects IS NOT NULL AND inspections IS NOT NULL AS ok
    FROM pipelines p
    LEFT JOIN (SELECT f.pipeline_id, count(*) AS total_objects, sum(inspections) AS inspections,
                      count(*) FILTER (h.n > 0) AS defect_objects,
                      count(*) FILTER (status = 'success' AND risk_probability > 0.6) AS critical_objects_count
               FROM forecast f LEFT JOIN history h USING (object_id) GROUP BY f.pipeline_id) USING (pipeline_id)
    LEFT JOIN last_year USING (pipeline_id))"""
_O = (*_F, _LAST_YEAR, _OUTLOOK)
_ADVICE = (f"CASE WHEN share > 0.5 OR critical_objects_count > 10 THEN '{s.ADVICE_REPAIR}' "
           f"WHEN share > 0.3 OR critical_objects_count > 5 THEN '{s.ADVICE_ATTENTION}' "
           f"WHEN share > 0.15 THEN '{s.ADVICE_REGULAR}' ELSE '{s.ADVICE_GOOD}' END")
oracle("trunkline_forecast", P + O + D, f"""
    SELECT pipeline_id, name, CASE WHEN ok THEN 'success' ELSE 'error' END AS status,
           CASE WHEN total_objects IS NULL THEN '{s.MSG_NO_OBJECTS}'
                WHEN NOT ok THEN '{s.MSG_NO_DIAGNOSTICS}' END AS message,
           CASE WHEN ok THEN total_objects END AS total_objects,
           CASE WHEN ok THEN round_even(share, 2) END AS defect_rate,
           CASE WHEN ok THEN critical_objects_count END AS critical_objects_count,
           CASE WHEN ok THEN n END AS defects_last_year,
           CASE WHEN ok THEN {_GROWN} END AS predicted_defects_next_year,
           CASE WHEN ok THEN {_ADVICE} END AS recommendation FROM outlook""", *_O)
oracle("trunkline_recommendation", P + O + D,
       f"SELECT pipeline_id, CASE WHEN ok THEN {_ADVICE} END AS recommendation FROM outlook", *_O)
oracle("forecast_dashboard_trunklines", P + O + D, f"""
    SELECT pipeline_id, name AS pipeline_name, critical_objects_count AS critical_count,
           round_even(share, 2) AS defect_rate, {_GROWN} AS predicted_defects FROM outlook WHERE ok""", *_O)
oracle("forecast_dashboard_summary", O + D, f"""
    SELECT count(*) FILTER (risk_probability > 0.6) AS high_risk_objects,
           count(*) FILTER (risk_probability > 0.3 AND risk_probability <= 0.6) AS medium_risk_objects,
           (SELECT count(*) FROM objects) AS total_analyzed FROM ({_top_risks(10)})""", *_F)
oracle("risk_band", O + D, f"""
    SELECT object_id, CASE WHEN risk_probability > 0.6 THEN '{s.BAND_HIGH}'
                           WHEN risk_probability > 0.3 THEN '{s.BAND_MEDIUM}' ELSE '{s.BAND_LOW}' END AS band
    FROM forecast""".replace("> 0.3 ", "> 0.3::double "), *_F)
oracle("trend_label", O + D, f"""
    SELECT object_id, CASE trend WHEN 'increasing' THEN '{s.TREND_WORSE}' WHEN 'decreasing' THEN '{s.TREND_BETTER}'
                                 ELSE '{s.TREND_STABLE}' END AS label FROM forecast""", *_F)
oracle("depth_flags", O + D, """
    SELECT object_id, coalesce(current_depth > 30, false) AS current_critical,
           coalesce(predicted_depth > 50, false) AS predicted_critical FROM forecast""", *_F)
oracle("report_recommendations", D, f"""
    SELECT cast(row_number() OVER (ORDER BY i) - 1 AS int) AS position, line
    FROM (SELECT 1 AS i, CASE WHEN risk_high > 0 THEN printf('{s.LINE_HIGH}', risk_high) END AS line FROM summary
          UNION ALL SELECT 2, CASE WHEN risk_medium > 10 THEN printf('{s.LINE_MEDIUM}', risk_medium) END FROM summary
          UNION ALL SELECT 3, CASE WHEN defect_rate > 50 THEN
                printf('{s.LINE_DEFECT_RATE}', cast(defect_rate AS varchar)) END FROM summary
          UNION ALL SELECT 4, '{s.LINE_CONTINUE}' UNION ALL SELECT 5, '{s.LINE_METHODS}')
    WHERE line IS NOT NULL""", f"summary AS ({_summary('true')})")

# --- alerts ------------------------------------------------------------------------------------------------
_DEFECT_ALERTS = f"""defect_alerts AS (
    SELECT 'defect_detection-' || cast(diag_id AS varchar) AS alert_id,
           printf('{s.ALERT_DEFECT}', coalesce(pipeline_id, '-'), cast(object_id AS varchar))
             || CASE ml_label WHEN 'high' THEN '{s.ALERT_SUFFIX_HIGH}'
                     WHEN 'medium' THEN '{s.ALERT_SUFFIX_MEDIUM}' ELSE '' END AS message,
           CASE ml_label WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'info' END AS type,
           pipeline_id, object_id, ml_label AS risk_level, 'defect_detection' AS category
    FROM diagnostics LEFT JOIN objects USING (object_id) WHERE defect_found)"""
oracle("defect_alerts", D + O, "SELECT * FROM defect_alerts", _DEFECT_ALERTS)
oracle("stream_defect_alerts", D + O, "SELECT * FROM defect_alerts", _DEFECT_ALERTS)
oracle("alert_log", D + O, f"""
    SELECT alert_id, 'created' AS action, message, type, '{AS_OF} 00:00:00' AS event_at, risk_level,
           cast(object_id AS varchar) AS object_id FROM defect_alerts""", _DEFECT_ALERTS)
oracle("run_alerts", O + DD, f"""
    SELECT printf('{s.ALERT_OBJECTS_IMPORTED}', (SELECT count(*) FROM objects), 'objects.csv') AS message,
           'success' AS type
    UNION ALL
    SELECT printf('{s.ALERT_IMPORT_FAILED}', 'diagnostics.csv',
                  printf('{s.ERR_DUPLICATES}', 'diag_id', (SELECT examples FROM repeats)) || '; '
                  || printf('{s.ERR_ORPHANS}', (
                      SELECT string_agg(coalesce(cast(object_id AS varchar), 'null'), ', ' ORDER BY object_id NULLS FIRST)
                      FROM (SELECT DISTINCT object_id FROM diagnostics_dirty
                            WHERE {_ORPHAN.format('objects')} ORDER BY object_id NULLS FIRST LIMIT 10)))), 'error'""",
       f"repeats AS ({_repeats('diagnostics_dirty', 'diag_id')})")
oracle("report_alerts", P, f"""
    SELECT 'report-' || pipeline_id AS alert_id, printf('{s.ALERT_REPORT}', 'PDF', pipeline_id) AS message,
           'success' AS type, pipeline_id, 'PDF' AS report_type, 'report_generation' AS category FROM pipelines""")
_CURRENT = """folded AS (
    SELECT alert_id, min(event_at) FILTER (action = 'created') AS created_at,
           any_value(message) AS message, any_value(type) AS type,
           min(event_at) FILTER (action = 'read') AS read_at,
           min(event_at) FILTER (action = 'deleted') AS deleted_at
    FROM alert_events WHERE alert_id IS NOT NULL GROUP BY alert_id),
read_alls AS (SELECT DISTINCT event_at AS marked_at FROM alert_events WHERE action = 'read_all'),
state AS (
    SELECT alert_id, message, type, created_at,
           read_at IS NOT NULL OR created_at <= (SELECT max(marked_at) FROM read_alls) AS is_read
    FROM folded WHERE deleted_at IS NULL)"""
_SHOWN = "alert_id, message, type, is_read, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at"
oracle("current_alerts", E, f"SELECT {_SHOWN} FROM state", _CURRENT)
oracle("list_alerts", E, f"""
    SELECT * EXCLUDE (t) FROM (SELECT {_SHOWN}, created_at AS t FROM state WHERE NOT is_read)
    ORDER BY t DESC, alert_id LIMIT 50""".replace("created_at AS t", "state.created_at AS t"), _CURRENT)
oracle("unread_count", E, "SELECT count(*) FILTER (NOT is_read) AS unread_count FROM state", _CURRENT)
oracle("read_all_marks", E, """
    SELECT strftime(marked_at, '%Y-%m-%d %H:%M:%S') AS event_at, count(alert_id) AS marked_count
    FROM read_alls LEFT JOIN (
        SELECT * FROM folded f ASOF JOIN (SELECT marked_at AS next_at FROM read_alls) n ON f.created_at <= n.next_at) a
      ON marked_at = next_at AND (read_at IS NULL OR read_at > marked_at)
         AND (deleted_at IS NULL OR deleted_at > marked_at)
    GROUP BY marked_at""", _CURRENT)
_MIN = f"datediff('second', created_at, TIMESTAMP '{AS_OF} 09:30:00')"
oracle("alert_age_bucket", E, f"""
    SELECT alert_id, CASE WHEN {_MIN} < 60 THEN '{s.AGE_NOW}'
        WHEN {_MIN} < 3600 THEN printf('{s.AGE_MINUTES}', cast(floor({_MIN} / 60) AS bigint))
        WHEN {_MIN} < 86400 THEN printf('{s.AGE_HOURS}', cast(floor({_MIN} / 3600) AS bigint))
        WHEN {_MIN} < 604800 THEN printf('{s.AGE_DAYS}', cast(floor({_MIN} / 86400) AS bigint))
        ELSE strftime(created_at, '%d.%m.%Y') END AS age FROM state""", _CURRENT)

# --- streams ------------------------------------------------------------------------------------------------
oracle("stream_import", DD + O, """
    SELECT diag_id, object_id, date, reasons = '' AS is_accepted, reasons
    FROM (SELECT *, concat_ws(',',
                 CASE WHEN diag_id IS NULL THEN 'null_diag_id' END,
                 CASE WHEN try_cast(date AS date) IS NULL THEN 'invalid_date' END,
                 CASE WHEN count(*) OVER (PARTITION BY diag_id) > 1 THEN 'duplicate_diag_id' END,
                 CASE WHEN object_id NOT IN (SELECT object_id FROM objects) THEN 'orphan_object_id' END) AS reasons
          FROM diagnostics_dirty)""")
