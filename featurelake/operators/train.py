"""Classifier training on executors, cross-validation and model persistence."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelake.operators import cells
from featurelake.operators.evaluate import binary_metrics, roc_auc
from featurelake.operators.split import SEED, stratified_folds, with_class_weight
from featurelake.session import cut_lineage, on_all_cores

# The three model settings.
FOREST = {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 2}
BOOSTING = {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1}
LOGISTIC = {"maxIter": 1000}
MODEL_TYPES = ("random_forest", "gradient_boosting", "logistic_regression")
METRICS = ("accuracy", "precision", "recall", "f1_score", "roc_auc")
TREES = ("random_forest", "gradient_boosting")
# Fewer rows train trees where they lie; more are dealt out, so many to a task at most.
DEALT_FROM, ROWS_A_TASK = 100_000, 2_000_000
# From so many rows on it is tried whether cells make less work.
CELLS_FROM = 1_000_000


def classifier(model_type: str, rows: int | None = None, seed: int = SEED, **overrides):
    """Unfitted classifier. Forest and logistic model use the balanced ``weight`` column.

    The logistic penalty equals a regularisation constant of 1: balanced weights sum to the number
    of rows, hence ``1 / rows``.
    """
    common = {"featuresCol": "features", "labelCol": "label"}
    if model_type == "random_forest":
        return RandomForestClassifier(**common, weightCol="weight", seed=seed, **{**FOREST, **overrides})
    if model_type == "gradient_boosting":
        return GBTClassifier(**common, seed=seed, **{**BOOSTING, **overrides})
    if model_type == "logistic_regression":
        penalty = {"standardization": False, "regParam": 1.0 / rows if rows else 0.0}
        return LogisticRegression(**common, weightCol="weight", **{**LOGISTIC, **penalty, **overrides})
    raise ValueError(f"model type {model_type!r} is not one of {MODEL_TYPES}")


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """Rows with features, dealt evenly to all cores and held on disk, ``ROWS_A_TASK`` to a task at most.

    A level of a forest is one pass over the rows and all trees. In order of their features neighbours reach the same nodes, which
    then stay in the processor's cache; that takes half the time of a pass in any other order.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = cores * math.ceil(max(rows, 1) / ROWS_A_TASK / cores)
    columns = [c for c in ("label", "weight", "features") if c in df.columns]
    return df.select(*columns).repartition(tasks).sortWithinPartitions(vector_to_array("features")).persist(StorageLevel.DISK_ONLY)


def train(df: DataFrame, model_type: str, seed: int = SEED, stages: Sequence = (), **overrides) -> PipelineModel:
    """Fit transforms and classifier as one pipeline on rows with ``label``."""
    if model_type not in MODEL_TYPES:
        raise ValueError(f"model type {model_type!r} is not one of {MODEL_TYPES}")
    rows = df.count()
    weighted = with_class_weight(df, "label")
    if model_type not in TREES or rows < DEALT_FROM:
        return Pipeline(stages=[*stages, classifier(model_type, rows, seed, **overrides)]).fit(weighted)
    transforms = Pipeline(stages=list(stages)).fit(weighted)
    unfitted = classifier(model_type, rows, seed, **overrides)
    ready = transforms.transform(weighted)
    forest = model_type == "random_forest"
    alike = ready if forest else ready.withColumn("weight", F.lit(1.0))  # boosting does not weigh classes
    found = cells.cells_of(alike, rows, unfitted.getMaxBins()) if rows >= CELLS_FROM and by_cells(unfitted) else None
    if found is not None:
        return PipelineModel([*transforms.stages, (cells.forest if forest else cells.boosted)(found, unfitted)])
    ready = dealt(ready, rows)
    try:
        return PipelineModel([*transforms.stages, unfitted.fit(ready)])
    finally:
        ready.unpersist()


def by_cells(unfitted) -> bool:
    """Whether rows of one cell are alike to the classifier; boosting on a sample or with rows held back asks for single rows."""
    return isinstance(unfitted, RandomForestClassifier) or (
        unfitted.getSubsamplingRate() == 1.0 and not unfitted.isDefined("validationIndicatorCol"))


def predict_rows(model, df: DataFrame) -> DataFrame:
    """Prediction as int and the class-1 probability as score."""
    return model.transform(df).withColumns({
        "prediction": F.col("prediction").cast("int"),
        "score": F.element_at(vector_to_array("probability"), 2),
    })


def feature_importance(model, names: Sequence[str]) -> DataFrame:
    """(feature, importance) in descending order; as many rows as features."""
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    values = [float(v) for v in last.featureImportances.toArray()]
    labelled = [(names[i] if i < len(names) else f"feature_{i}", v) for i, v in enumerate(values)]
    spark = SparkSession.active()
    return spark.createDataFrame(labelled, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def held_out_scores(df: DataFrame, model_type: str, key: str, folds: int = 5, seed: int = SEED, **overrides) -> DataFrame:
    """key, fold, label, prediction and score of every row, scored by the model of the folds without it."""
    parts = cut_lineage(stratified_folds(df.select(key, "label", "features"), "label", key, folds, seed))
    held_out = None
    for fold in range(folds):
        model = train(parts.where(F.col("fold") != fold).drop("fold"), model_type, seed, **overrides)
        scored = predict_rows(model, on_all_cores(parts.where(F.col("fold") == fold))).select(key, "fold", "label", "prediction", "score")
        held_out = scored if held_out is None else held_out.unionByName(scored)
    return cut_lineage(held_out)


def fold_summary(held_out: DataFrame) -> DataFrame:
    """Mean and population deviation of the five metrics over the folds."""
    per_fold = binary_metrics(held_out, keys=["fold"]).join(roc_auc(held_out, keys=["fold"]), "fold")
    long = per_fold.unpivot(["fold"], list(METRICS), "metric", "value")
    return long.groupBy("metric").agg(F.round(F.avg("value"), 4).alias("mean"),
                                      F.round(F.stddev_pop("value"), 4).alias("std"))


def cross_validate(df: DataFrame, model_type: str, key: str, folds: int = 5, seed: int = SEED,
                   **overrides) -> DataFrame:
    """Mean and population deviation of five metrics over stratified folds.

    Each fold's model is fitted once; all metrics come from one frame holding every held-out row
    scored by the model that has not seen it.
    """
    return fold_summary(held_out_scores(df, model_type, key, folds, seed, **overrides))


def logistic_gradient(model, df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per coefficient and intercept the derivative of the penalised weighted loss, and the size of the terms it is a sum of.

    ``df`` holds the rows the model was fitted on, with label. A fitted model's derivatives are near 0.
    """
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    rows = with_class_weight(df, "label")
    x = vector_to_array("features")
    coefficients = [float(c) for c in last.coefficients]
    z = sum((x[i] * F.lit(c) for i, c in enumerate(coefficients)), F.lit(float(last.intercept)))
    away = rows.select("weight", x.alias("x"), (F.col("weight") * (1 / (1 + F.exp(-z)) - F.col("label"))).alias("e"))
    terms = {**{n: (F.col("x")[i], coefficients[i]) for i, n in enumerate(names)}, "intercept": (F.lit(1.0), 0.0)}
    aggs = [F.sum("weight").alias("w")]
    for i, (value, _) in enumerate(terms.values()):
        aggs += [F.sum(F.col("e") * value).alias(f"g{i}"), F.sum(F.abs(F.col("e") * value)).alias(f"s{i}")]
    penalty = float(last.getRegParam())
    out = [F.struct(F.lit(n).alias("term"), (F.col(f"g{i}") / F.col("w") + F.lit(penalty * c)).alias("gradient"),
                    (F.col(f"s{i}") / F.col("w")).alias("size")) for i, (n, (_, c)) in enumerate(terms.items())]
    return away.agg(*aggs).select(F.inline(F.array(*out)))


def evaluate(scored: DataFrame) -> DataFrame:
    """One row with the five metrics of scored rows; the rows are scored once and kept narrow."""
    scored = cut_lineage(scored.select("label", "prediction", "score"))
    metrics = {**binary_metrics(scored).first().asDict(), **roc_auc(scored).first().asDict()}
    return scored.sparkSession.createDataFrame(
        [tuple(metrics[m] for m in METRICS)], ", ".join(f"{m} double" for m in METRICS))


def save_model(model: PipelineModel, base: str, version: str) -> str:
    """Persist transforms and classifier together; ``versions`` below ``base`` stay side by side."""
    path = f"{base.rstrip('/')}/version={version}"
    model.write().save(path)
    return path


RECORD_SCHEMA = ("version string, model_type string, path string, trained_at timestamp, metrics map<string,double>, "
                 "importances map<string,double>")


def record_model(spark: SparkSession, base: str, version: str, model_type: str, path: str, metrics: dict[str, float],
                 importances: dict[str, float] | None = None) -> None:
    """Append a model's record below ``base``; the newest record is the pointer to the latest model."""
    row = (version, model_type, path, datetime.now(timezone.utc), metrics, importances or {})
    spark.createDataFrame([row], RECORD_SCHEMA).write.mode("append").parquet(f"{base.rstrip('/')}/records")


def model_records(spark: SparkSession, base: str) -> DataFrame:
    """Records of all saved models, newest first."""
    return spark.read.schema(RECORD_SCHEMA).parquet(f"{base.rstrip('/')}/records").orderBy(F.desc("trained_at"), F.desc("version"))


def load_latest(spark: SparkSession, base: str) -> PipelineModel:
    return load_model(model_records(spark, base).first()["path"])


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def stage_path(model_path: str, model: PipelineModel) -> str:
    """Folder of the classifier inside a saved pipeline."""
    last = len(model.stages) - 1
    return f"{model_path}/stages/{last:0{len(str(len(model.stages)))}d}_{model.stages[-1].uid}"
