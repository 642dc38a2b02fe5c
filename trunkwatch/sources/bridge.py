"""Inspection tables as views over the star-schema test tables.

The text of each view runs in Spark SQL and in DuckDB alike; ``{name}`` marks
the tables it reads. Spark binds them to DataFrames, the oracles to CTE names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "pipelines": """
        SELECT 'MT-' || lpad(cast(n_nationkey AS string), 2, '0') AS pipeline_id,
               n_name AS name,
               100 + n_nationkey * 37 AS length_km,
               CASE WHEN n_nationkey % 2 = 0 THEN 720 ELSE 530 END AS diameter_mm,
               r_name AS start_point,
               n_name AS end_point,
               1960 + n_nationkey AS year_built,
               'operator-' || cast(n_regionkey AS string) AS operator
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "objects": """
        SELECT c_custkey AS object_id,
               c_name AS object_name,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'crane'
                                 WHEN 'MACHINERY' THEN 'compressor'
                                 ELSE 'pipeline_section' END AS object_type,
               'MT-' || lpad(cast(c_nationkey AS string), 2, '0') AS pipeline_id,
               43 + cast((c_custkey * 7919) % 100000 AS double) / 10000 AS lat,
               50 + cast((c_custkey * 6007) % 100000 AS double) / 10000 AS lon,
               cast(1965 + c_custkey % 56 AS int) AS year,
               CASE c_custkey % 6 WHEN 0 THEN 'Ст3' WHEN 1 THEN '09Г2С' WHEN 2 THEN '17Г1С'
                    WHEN 3 THEN '10Г2ФБ' WHEN 4 THEN 'Х70' ELSE 'Х65' END AS material
        FROM {customer}""",
    "diagnostics": """
        SELECT diag_id, object_id, method, date, temperature, humidity, illumination, defect_found,
               CASE WHEN defect_found THEN o_orderpriority END AS defect_description,
               CASE WHEN defect_found THEN grade ELSE 'удовлетворительно' END AS quality_grade,
               CASE WHEN defect_found THEN cast((diag_id * 37) % 6000 AS double) / 100 END AS param1,
               CASE WHEN defect_found THEN 10 + cast((diag_id * 53) % 4900 AS double) / 10 END AS param2,
               CASE WHEN defect_found THEN 5 + cast((diag_id * 71) % 1950 AS double) / 10 END AS param3,
               CASE WHEN NOT defect_found THEN 'normal'
                    WHEN grade = 'недопустимо' OR (diag_id * 37) % 6000 > 5000 THEN 'high'
                    WHEN grade = 'требует_мер' OR (diag_id * 37) % 6000 > 3000 THEN 'medium'
                    ELSE 'normal' END AS ml_label
        FROM (SELECT o_orderkey AS diag_id,
                     o_custkey AS object_id,
                     CASE o_orderkey % 11 WHEN 0 THEN 'VIK' WHEN 1 THEN 'UZK' WHEN 2 THEN 'MFL'
                          WHEN 3 THEN 'TFI' WHEN 4 THEN 'GEO' WHEN 5 THEN 'MPK' WHEN 6 THEN 'PVK'
                          WHEN 7 THEN 'RGK' WHEN 8 THEN 'TVK' WHEN 9 THEN 'VIBRO'
                          ELSE 'UTWM' END AS method,
                     cast(cast(o_orderdate AS date) AS string) AS date,
                     cast((o_orderkey * 13) % 750 AS double) / 10 - 30 AS temperature,
                     20 + cast((o_orderkey * 17) % 750 AS double) / 10 AS humidity,
                     100 + cast((o_orderkey * 29) % 9000 AS double) / 10 AS illumination,
                     o_orderstatus <> 'O' AND o_custkey % 20 <> 0 AS defect_found,
                     CASE o_orderpriority WHEN '1-URGENT' THEN 'недопустимо'
                          WHEN '2-HIGH' THEN 'требует_мер'
                          WHEN '3-MEDIUM' THEN 'допустимо'
                          ELSE 'удовлетворительно' END AS grade,
                     o_orderpriority
              FROM {orders}) o""",
    "diagnostics_dirty": """
        SELECT CASE WHEN diag_id % 101 = 0 AND diag_id > 0 THEN diag_id - 1 ELSE diag_id END AS diag_id,
               CASE WHEN diag_id % 97 = 0 THEN -1 - object_id ELSE object_id END AS object_id,
               CASE WHEN diag_id % 89 = 0 THEN 'XX' WHEN diag_id % 88 = 0 THEN 'AE' ELSE method END AS method,
               CASE WHEN diag_id % 83 = 0 THEN '2024-13-45' WHEN diag_id % 84 = 0 THEN NULL ELSE date END AS date,
               defect_found,
               CASE WHEN diag_id % 79 = 0 THEN 'unknown' ELSE quality_grade END AS quality_grade,
               CASE WHEN diag_id % 73 = 0 THEN 'critical' ELSE ml_label END AS ml_label,
               CASE WHEN diag_id % 7 = 0 THEN NULL ELSE param1 END AS param1
        FROM {diagnostics}""",
    "objects_dirty": """
        SELECT CASE WHEN object_id % 31 = 0 AND object_id > 0 THEN object_id - 1 ELSE object_id END AS object_id,
               CASE WHEN object_id % 43 = 0 THEN NULL ELSE object_name END AS object_name,
               CASE WHEN object_id % 37 = 0 THEN 'valve' ELSE object_type END AS object_type,
               pipeline_id,
               CASE WHEN object_id % 41 = 0 THEN 95.0 ELSE lat END AS lat,
               CASE WHEN object_id % 47 = 0 THEN -181.0 ELSE lon END AS lon
        FROM {objects}""",
    # readings with NaN and infinities, as broken sensors leave them
    "diagnostics_nonfinite": """
        SELECT diag_id, object_id, method, date,
               CASE WHEN diag_id % 9 = 0 THEN cast('NaN' AS double)
                    WHEN diag_id % 9 = 1 THEN cast('Infinity' AS double) ELSE temperature END AS temperature,
               CASE WHEN diag_id % 9 = 2 THEN cast('-Infinity' AS double) ELSE humidity END AS humidity,
               CASE WHEN diag_id % 9 = 3 THEN cast('NaN' AS double) ELSE param1 END AS param1
        FROM {diagnostics}""",
    # what happened to the alerts: one created row per defect, some of them read
    # or deleted later, and a read-all at the start of every month
    "alert_events": """
        SELECT 'defect-' || cast(diag_id AS string) AS alert_id, 'created' AS action,
               cast(date AS timestamp) + INTERVAL '8' HOUR AS event_at,
               'defect ' || cast(diag_id AS string) AS message,
               CASE ml_label WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'info' END AS type
        FROM {diagnostics} WHERE defect_found
        UNION ALL
        SELECT 'defect-' || cast(diag_id AS string), 'read',
               cast(date AS timestamp) + INTERVAL '10' DAY, NULL, NULL
        FROM {diagnostics} WHERE defect_found AND diag_id % 3 = 0
        UNION ALL
        SELECT 'defect-' || cast(diag_id AS string), 'deleted',
               cast(date AS timestamp) + INTERVAL '20' DAY, NULL, NULL
        FROM {diagnostics} WHERE defect_found AND diag_id % 7 = 0
        UNION ALL
        SELECT NULL, 'read_all', m, NULL, NULL
        FROM (SELECT DISTINCT date_trunc('month', cast(date AS timestamp)) AS m FROM {diagnostics}) months
        WHERE m < TIMESTAMP '2001-06-01 00:00:00'""",
}

READS = {
    "pipelines": ("nation", "region"),
    "objects": ("customer",),
    "diagnostics": ("orders",),
    "diagnostics_dirty": ("diagnostics",),
    "objects_dirty": ("objects",),
    "diagnostics_nonfinite": ("diagnostics",),
    "alert_events": ("diagnostics",),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view, or the plain parquet table of that name."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    inputs = {read: view(spark, sf_dir, read) for read in READS[name]}
    return spark.sql(VIEWS[name], **inputs)


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the named views, and those they read, for DuckDB."""
    wanted: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in wanted:
            for read in READS[name]:
                add(read)
            wanted.append(name)

    for name in names:
        add(name)
    ctes = [f"{name} AS ({VIEWS[name].format(**{r: r for r in READS[name]})})" for name in wanted]
    return "WITH " + ",\n".join(ctes)
