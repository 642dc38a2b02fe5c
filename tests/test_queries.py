"""Every query against its SQL in DuckDB, over the whole small tables."""

import math
from pathlib import Path

import duckdb
import pytest
from helpers import SMALL

import __spark_entry__ as contract
from trunkwatch.plans.catalog import QUERIES
from trunkwatch.plans.oracles import ORACLES

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "date": "DATE"}
WITHOUT_SQL = {"model_accuracy", "score_defects", "feature_importance", "training_alerts"}


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def tidy(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    return value


def ordered(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(tidy(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_sql_but_for_those_of_the_fitted_model():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert not set(contract.oracle_sql()) - set(contract.queries())
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() == 20


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_same_as_sql(spark, duck, key):
    df = contract.queries()[key](spark, SMALL)
    result = duck.execute(contract.oracle_sql()[key])
    kinds = {c[0]: str(c[1]) for c in result.description}
    assert {n: KINDS[t] for n, t in df.dtypes} == kinds
    assert ordered(df.columns, df.collect()) == ordered(list(kinds), result.fetchall())


@pytest.mark.parametrize("key", sorted(WITHOUT_SQL))
def test_model_queries_give_rows(spark, key):
    assert contract.queries()[key](spark, SMALL).count() > 0
