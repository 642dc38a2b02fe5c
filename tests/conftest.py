import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from trunkwatch import schema as s  # noqa: E402
from trunkwatch.session import session  # noqa: E402

@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    spark = session("tests", f"local[{os.cpu_count()}]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.checkpoint.dir": str(shared), "spark.sql.maxMetadataStringLength": "4000",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Builds a table from partial rows; what a row leaves out is null."""
    def build(schema, *rows):
        names = schema.fieldNames()
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
    return build


@pytest.fixture(scope="session")
def diagnostics(table):
    def build(*rows):
        defaults = {"method": "UZK", "defect_found": False, "quality_grade": "допустимо",
                    "ml_label": "normal"}
        return table(s.DIAGNOSTICS, *[{**defaults, "diag_id": i, **r} for i, r in enumerate(rows, 1)])
    return build


@pytest.fixture(scope="session")
def objects(table):
    def build(*rows):
        defaults = {"object_type": "crane", "pipeline_id": "MT-01", "lat": 50.0, "lon": 60.0}
        return table(s.OBJECTS, *[
            {**defaults, "object_name": f"object {r['object_id']}", **r} for r in rows])
    return build


@pytest.fixture(scope="session")
def pipelines(table):
    def build(*ids):
        return table(s.PIPELINES, *[{"pipeline_id": i, "name": f"line {i}"} for i in ids])
    return build
