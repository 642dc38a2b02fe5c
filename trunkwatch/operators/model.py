"""Criticality classifier: features, balanced random forest, batch scoring."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml import Pipeline as Stages
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from trunkwatch.functions.criticality import features, rule_confidence, rule_label
from trunkwatch.operators.listing import defects_only
from trunkwatch.schema import FEATURES

MIN_ROWS = 10
TREES, DEPTH, SEED = 100, 10, 42
#: The forest keeps some 1.3 KB of each row (its draws and its node, an integer each per
#: tree), and a task reads those of its whole partition at every level: 130 MB.
ROWS_PER_PARTITION = 100_000


def defect_features(diagnostics: DataFrame, *keep: str) -> DataFrame:
    """The classifier's inputs, in order, after the columns to keep."""
    values = features()
    return diagnostics.select(*keep, *[values[name].cast("double").alias(name) for name in FEATURES])


def class_weights(diagnostics: DataFrame) -> DataFrame:
    """Weight of each label among the defects: n / (classes * n of the label)."""
    defects = defects_only(diagnostics).where(F.col("ml_label").isNotNull())
    counts = defects.groupBy("ml_label").agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("labels"))).scalar()
    return counts.select("ml_label", "n", (
        totals["rows"] / (totals["labels"] * F.col("n"))).alias("weight"))


@dataclass
class Fit:
    """A fitted model, or none where there were too few defects."""
    model: PipelineModel | None
    labels: list[str]
    metrics: DataFrame | None
    fit_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def is_trained(self) -> bool:
        return self.model is not None


def split(rows: DataFrame) -> DataFrame:
    """Marks every fifth row, by a hash of its id, as held out. The mark does not
    depend on how the data is partitioned or on a recomputed task."""
    return rows.withColumn("held_out", F.pmod(F.xxhash64("diag_id"), F.lit(5)) == 0)


def spread(rows: DataFrame, n_rows: int) -> DataFrame:
    """Rows dealt evenly by id, those without one by their inputs, whatever the layout of
    the files: a partition per core at least, of ``ROWS_PER_PARTITION`` rows at most."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows // ROWS_PER_PARTITION))
    without_id = F.when(F.col("diag_id").isNull(), F.xxhash64(*FEATURES))
    return rows.repartition(parts, "diag_id", without_id)


def _weight_by_label(weights: DataFrame) -> Column:
    """The weight of a row's label, from one map. The model keeps every label on the
    driver, so their map fits; a join would shuffle all rows by label."""
    entries = F.map_from_entries(F.collect_list(F.struct("ml_label", "weight")))
    return F.element_at(weights.agg(entries).scalar(), F.col("label_text"))


def train(diagnostics: DataFrame) -> Fit:
    """Random forest on the defects, with accuracy on both parts of the split."""
    defects = split(defects_only(diagnostics).where(F.col("ml_label").isNotNull()))
    n_rows = defects.count()
    if n_rows < MIN_ROWS:
        return Fit(None, [], None)
    weight = _weight_by_label(class_weights(defects.where(~F.col("held_out"))))
    # Trees read their input many times over: spread it and keep it.
    rows = defect_features(defects, "diag_id", F.col("ml_label").alias("label_text"), "held_out")
    rows = spread(rows.withColumn("weight", weight), n_rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stages = Stages(stages=[
            StringIndexer(inputCol="label_text", outputCol="label",
                          stringOrderType="alphabetAsc", handleInvalid="keep"),
            VectorAssembler(inputCols=FEATURES, outputCol="inputs"),
            RandomForestClassifier(
                labelCol="label", featuresCol="inputs", weightCol="weight", numTrees=TREES,
                maxDepth=DEPTH, featureSubsetStrategy="sqrt", seed=SEED, maxMemoryInMB=1024,
                cacheNodeIds=True),
        ])
        model = stages.fit(rows.where(~F.col("held_out")))
        labels = list(model.stages[0].labels)
        metrics = _metrics(model.transform(rows), labels)
    finally:
        rows.unpersist()
    return Fit(model, labels, metrics)


def _metrics(scored: DataFrame, labels: list[str]) -> DataFrame:
    hit = (F.col("prediction") == F.col("label")).cast("double")
    row = scored.agg(
        F.avg(F.when(~F.col("held_out"), hit)).alias("train_accuracy"),
        F.avg(F.when(F.col("held_out"), hit)).alias("test_accuracy"),
        F.count("*").alias("n_samples")).first()
    return scored.sparkSession.createDataFrame(
        [(row["train_accuracy"], row["test_accuracy"], row["n_samples"], labels)],
        "train_accuracy double, test_accuracy double, n_samples long, classes array<string>")


def score(fit: Fit, diagnostics: DataFrame) -> DataFrame:
    """Label, confidence and probability per label, both in percent, of every row.

    Without a model the rules decide, and are certain of it.
    """
    if not fit.is_trained:
        label = rule_label()
        return diagnostics.select(
            "diag_id", label.alias("ml_label"), F.lit(100.0).alias("confidence"),
            F.create_map(label, F.lit(1.0)).alias("probabilities"),
            F.lit("rule_based").alias("model_type"))
    forest_input = defect_features(diagnostics, "diag_id")
    share = vector_to_array("probability")
    scored = PipelineModel(fit.model.stages[1:]).transform(forest_input)
    names = F.array(*[F.lit(name) for name in fit.labels])
    return scored.select(
        "diag_id",
        names[F.col("prediction").cast("int")].alias("ml_label"),
        F.round(F.array_max(share) * 100, 2).alias("confidence"),
        F.map_from_arrays(names, F.transform(F.slice(share, 1, len(fit.labels)), lambda p: p * 100))
        .alias("probabilities"),
        F.lit("ml").alias("model_type"))


def rule_scores(diagnostics: DataFrame) -> DataFrame:
    """Label and confidence by rule for every row."""
    return diagnostics.select("diag_id", rule_label().alias("ml_label"),
                              rule_confidence().alias("confidence"))


def feature_importance(spark, fit: Fit) -> DataFrame:
    """Importance of each of the model's inputs."""
    values = fit.model.stages[-1].featureImportances if fit.is_trained else []
    rows = [(name, float(values[i])) for i, name in enumerate(FEATURES)] if fit.is_trained else []
    return spark.createDataFrame(rows, "feature string, importance double")
