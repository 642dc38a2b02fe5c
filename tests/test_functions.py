import datetime as dt
import math

import pytest
from helpers import dicts
from pyspark.sql import functions as F

from trunkwatch.functions import banding, cleaning, criticality, text
from trunkwatch.functions.geo import along


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(
        f"{n} {'string' if isinstance(v, str) else 'double'}" for n, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given, expected", [
    ("Щука №5 — объём", "Shchuka No.5 - obyom"),
    ("Ёж – ЪЬъь Юля", "Yozh -  Yulya"),
    ("plain text 42", "plain text 42"),
])
def test_transliterate(spark, given, expected):
    assert one(spark, text.transliterate(F.col("t")), t=given) == expected


def test_text_cuts(spark):
    df = spark.createDataFrame([("compressor", "x" * 50), ("valve", None), (None, "short")], "t string, n string")
    rows = df.select(text.object_type_name(F.col("t")).alias("t"), text.cut(F.col("n"), 35).alias("n")).collect()
    assert [tuple(r) for r in rows] == [("Compressor", "x" * 35), ("valve", "-"), ("-", "short")]


@pytest.mark.parametrize("depth, erf, grade, label", [
    (10.0, None, "недопустимо", "high"),
    (50.0, None, "допустимо", "medium"),
    (50.1, None, "допустимо", "high"),
    (30.0, None, "допустимо", "normal"),
    (30.1, None, "допустимо", "medium"),
    (10.0, 0.7, "допустимо", "medium"),
    (10.0, 0.71, "допустимо", "high"),
    (10.0, 0.5, "допустимо", "normal"),
    (10.0, 0.0, "требует_мер", "medium"),
    (None, None, None, "normal"),
    (float("nan"), None, "допустимо", "normal"),
])
def test_risk_label(spark, depth, erf, grade, label):
    df = spark.createDataFrame([(depth, erf, grade)], "d double, e double, g string")
    assert df.select(criticality.risk_label(F.col("d"), F.col("e"), F.col("g"))).first()[0] == label


@pytest.mark.parametrize("row, label, confidence", [
    ({"defect_found": False, "param1": 60.0}, "normal", 95.0),
    ({"defect_found": True, "param1": 60.0}, "high", 90.0),
    ({"defect_found": True, "param1": 31.0}, "medium", 80.0),
    ({"defect_found": True, "param1": None}, "normal", 70.0),
    ({"defect_found": None, "param1": 60.0}, "normal", 95.0),
])
def test_rule_label(diagnostics, row, label, confidence):
    got = diagnostics({"object_id": 1, **row}).select(
        criticality.rule_label(), criticality.rule_confidence()).first()
    assert tuple(got) == (label, confidence)


@pytest.mark.parametrize("params, area, volume, ratio, shape", [
    ((10.0, 20.0, 5.0), 100.0, 1000.0, 10 / 101, 4.0),
    ((10.0, 0.0, 5.0), 0.0, 0.0, 0.0, 0.0),
    ((10.0, 20.0, 0.0), 0.0, 0.0, 0.0, 1.0),
    ((None, None, None), 0.0, 0.0, 0.0, 1.0),
])
def test_geometry(diagnostics, params, area, volume, ratio, shape):
    row = dict(zip(("param1", "param2", "param3"), params))
    values = criticality.geometry()
    got = diagnostics({"object_id": 1, **row}).select(*[v.alias(n) for n, v in values.items()]).first()
    assert got.asDict() == pytest.approx({
        "defect_area": area, "defect_volume": volume, "depth_to_area_ratio": ratio, "shape_index": shape})


def test_conditions_take_null_and_nan_as_zero(diagnostics):
    values = criticality.conditions()
    got = diagnostics({"object_id": 1, "temperature": None, "humidity": float("nan"), "illumination": 500.0}).select(
        *[v.alias(n) for n, v in values.items()]).first()
    assert got.asDict() == {"temp_normalized": 0.5, "humidity_normalized": 0.0, "illumination_normalized": 0.5}


def test_scores_and_flags(spark):
    df = spark.createDataFrame([("недопустимо", "MFL"), ("bad", "VIK"), (None, None)], "g string, m string")
    rows = df.select(criticality.quality_score(F.col("g")), criticality.critical_method(F.col("m"))).collect()
    assert [tuple(r) for r in rows] == [(4, 1), (1, 0), (1, 0)]


@pytest.mark.parametrize("back, shown", [
    (dt.timedelta(seconds=59), "только что"),
    (dt.timedelta(seconds=60), "1 мин назад"),
    (dt.timedelta(minutes=59, seconds=59), "59 мин назад"),
    (dt.timedelta(hours=1), "1 ч назад"),
    (dt.timedelta(hours=24), "1 дн назад"),
    (dt.timedelta(days=6, hours=23), "6 дн назад"),
    (dt.timedelta(days=7), "24.02.2024"),
])
def test_alert_age(spark, back, shown):
    now = dt.datetime(2024, 3, 2, 12)
    df = spark.createDataFrame([(now - back, now)], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(banding.alert_age(F.col("a"), F.col("b"))).first()[0] == shown


def test_bands(spark):
    df = spark.createDataFrame([(0.6, 30.0, 50.0), (0.61, 30.1, 50.1), (0.3, None, None)], "r double, c double, p double")
    flags = banding.depth_flags(F.col("c"), F.col("p"))
    rows = df.select(banding.risk_band(F.col("r")), *flags.values()).collect()
    assert [tuple(r) for r in rows] == [("Средний", False, False), ("Высокий", True, True), ("Низкий", False, False)]


def test_non_finite_to_null(spark):
    df = spark.createDataFrame([(1, 1.5, "a"), (2, math.nan, "NaN"), (3, math.inf, None), (4, -math.inf, "b")],
                               "i int, x double, t string")
    assert [r["x"] for r in dicts(cleaning.clean_non_finite(df))] == [1.5, None, None, None]
    assert [r["t"] for r in dicts(cleaning.clean_non_finite(df))] == ["a", "NaN", None, "b"]


def test_dates(spark):
    df = spark.createDataFrame([("2024-02-29",), ("2024-13-45",), ("2023-02-29",), ("",), (None,),
                                ("2024-01-05 10:30:00",)], "date string")
    assert [r["d"] for r in dicts(df.select(cleaning.inspected_on().alias("d")))] == [
        dt.date(2024, 2, 29), None, None, None, None, dt.date(2024, 1, 5)]


def test_rounding_ignores_the_last_bits(spark):
    values = [(-0.86325,), (-0.8632500000000003,), (-0.8632499999999997,)]
    df = spark.createDataFrame(values, "x double")
    assert {r["y"] for r in dicts(df.select(cleaning.rounded(F.col("x"), 4).alias("y")))} == {-0.8632}


def test_percent(spark):
    df = spark.createDataFrame([(1, 800), (1, 3), (0, 0)], "a long, b long")
    assert [r["p"] for r in dicts(df.select(cleaning.percent(F.col("a"), F.col("b")).alias("p")))] == [0.12, 33.33, 0.0]


def test_along(spark):
    assert one(spark, along(F.col("a"), F.col("b"), F.col("r")), a=10.0, b=20.0, r=0.25) == 12.5
