import pytest
from helpers import SMALL, dicts
from pyspark.sql import functions as F

from trunkwatch import schema as s
from trunkwatch.operators import model
from trunkwatch.sources.bridge import view


@pytest.fixture(scope="module")
def inspected(spark):
    return view(spark, SMALL, "diagnostics")


@pytest.fixture(scope="module")
def fit(inspected):
    return model.train(inspected)


def test_accuracy(fit):
    metrics = fit.metrics.first()
    assert metrics["classes"] == ["high", "medium", "normal"]
    assert metrics["train_accuracy"] > 0.97 and metrics["test_accuracy"] > 0.93


def test_scores(fit, inspected):
    scored = model.score(fit, inspected)
    rows = dicts(scored)
    assert len(rows) == inspected.count()
    for row in rows[:200]:
        assert sum(row["probabilities"].values()) == pytest.approx(100)
        assert row["confidence"] == pytest.approx(max(row["probabilities"].values()), abs=0.006)
        assert row["probabilities"][row["ml_label"]] == max(row["probabilities"].values())
    truth = scored.join(inspected.where("defect_found").select("diag_id", F.col("ml_label").alias("truth")), "diag_id")
    assert truth.agg(F.avg((F.col("ml_label") == F.col("truth")).cast("double"))).first()[0] > 0.95


def test_importance(spark, fit):
    values = {r["feature"]: r["importance"] for r in dicts(model.feature_importance(spark, fit))}
    assert list(values) == s.FEATURES and sum(values.values()) == pytest.approx(1)
    assert values["defect_found"] == 0  # constant among defects
    assert values["param1"] + values["is_deep_defect"] + values["quality_score"] > 0.5


def test_split_does_not_depend_on_layout(inspected):
    marks = [{r["diag_id"] for r in dicts(model.split(df).where("held_out"))}
             for df in (inspected, inspected.repartition(7), inspected.orderBy(F.rand(1)))]
    assert marks[0] == marks[1] == marks[2]
    assert 0.15 < len(marks[0]) / inspected.count() < 0.25


def test_weights(diagnostics):
    rows = diagnostics(*[{"object_id": 1, "defect_found": True, "ml_label": x} for x in ("high", "high", "high", "normal")],
                       {"object_id": 1, "defect_found": False, "ml_label": "medium"})
    assert {r["ml_label"]: r["weight"] for r in dicts(model.class_weights(rows))} == {
        "high": pytest.approx(4 / 6), "normal": 2.0}


def test_rules_decide_without_a_model(diagnostics):
    rows = diagnostics({"object_id": 1, "defect_found": True, "param1": 60.0}, {"object_id": 1})
    fit = model.train(rows)
    assert not fit.is_trained
    scored = dicts(model.score(fit, rows))
    assert [(r["ml_label"], r["confidence"], r["probabilities"], r["model_type"]) for r in scored] == [
        ("high", 100.0, {"high": 1.0}, "rule_based"), ("normal", 100.0, {"normal": 1.0}, "rule_based")]


def test_features_keep_their_order(inspected):
    assert model.defect_features(inspected).columns == s.FEATURES


def test_labels_may_be_many(diagnostics):
    rows = diagnostics(*[{"object_id": 1, "defect_found": True, "ml_label": f"l{i % 120}", "param1": float(i % 120)} for i in range(1200)])
    fit = model.train(rows)
    assert len(fit.labels) == 120 and fit.fit_id != model.Fit(None, [], None).fit_id


def test_forest_reads_small_partitions(spark):
    columns = [F.lit(0.0).alias(name) for name in s.FEATURES]
    rows = spark.range(0, 2_000_000, 1, 4).select(F.col("id").alias("diag_id"), *columns)
    dealt = model.spread(rows, 2_000_000)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2_000_000 and max(sizes) < 200_000


def test_rows_without_id_are_spread(spark):
    names = [F.col("id").cast("double").alias(name) for name in s.FEATURES]
    rows = spark.range(0, 4000, 1, 4).select(F.lit(None).cast("long").alias("diag_id"), *names)
    dealt = model.spread(rows, 4000)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2 * 4000 / dealt.rdd.getNumPartitions()


def test_ids_decide_the_partition_alone(spark):
    rows = spark.range(0, 4000, 1, 4).select(F.col("id").alias("diag_id"), *[F.rand(1).alias(name) for name in s.FEATURES])
    parts = spark.sparkContext.defaultParallelism
    found = [{(r["diag_id"], r["p"]) for r in dicts(df.select("diag_id", F.spark_partition_id().alias("p")))}
             for df in (model.spread(rows, 4000), rows.repartition(parts, "diag_id"))]
    assert found[0] == found[1]
