"""Training job: from a prepared entity table to a saved, evaluated and served model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelake.functions.ordering import global_index
from featurelake.operators.evaluate import classification_report, confusion_matrix
from featurelake.operators.features import TARGET, FeatureTransform, create_label
from featurelake.operators.prepare import prepare_dataset
from featurelake.operators.split import FOLDS, stratified_split
from featurelake.operators.train import cross_validate, evaluate, feature_importance, predict_rows, record_model, save_model, train
from featurelake.session import cut_lineage, on_all_cores
from featurelake.sources.offline import OfflineStore
from featurelake.sources.serving import ServingStore


@dataclass
class TrainingResult:
    model: PipelineModel
    model_path: str
    metrics: DataFrame
    confusion: DataFrame
    report: DataFrame
    cross_validation: DataFrame | None
    offline_path: str
    served_rows: int


def with_entity_id(df: DataFrame, order: Sequence[str], name: str = "entity_id") -> DataFrame:
    """Dense ids 1..n in the given total order."""
    return global_index(df, [F.col(c) for c in order], "__idx").withColumn(name, F.col("__idx") + 1).drop("__idx")


def training_job(spark: SparkSession, labelled: DataFrame, entity: str, label: str, numeric: Sequence[str],
                 categorical: Sequence[str], base: str, dataset: str = "training", version: str = "v1",
                 model_type: str = "random_forest", folds: int | None = FOLDS, **overrides) -> TrainingResult:
    """Store the labelled features, split, validate, fit, evaluate, save, and fill the serving tables.

    Later steps read the stored version, so the preparation runs once. Transforms are fitted on
    the training part only and saved with the classifier as one model; its record holds type, metrics
    and importances. ``folds=None`` leaves the cross-validation out.
    """
    offline, serving = OfflineStore(spark, f"{base}/offline"), ServingStore(spark, f"{base}/serving")
    path = offline.ingest(labelled, dataset, entity, version=version)
    rows = offline.get_dataset(dataset, version).withColumn("label", F.col(label).cast("double"))
    split = cut_lineage(stratified_split(rows, "label", entity))
    train_rows, test_rows = split.where("split = 'train'"), split.where("split = 'test'")

    transform = FeatureTransform(numeric=list(numeric), categorical=list(categorical))
    checked = None
    if folds:
        ready = transform.fit(train_rows).transform(train_rows).select(entity, "label", "features")
        checked = cross_validate(ready, model_type, entity, folds, **overrides)
    model = train(train_rows, model_type, stages=[transform], **overrides)
    scored = cut_lineage(predict_rows(model, on_all_cores(test_rows)).select("label", "prediction", "score"))
    metrics = evaluate(scored)
    model_path = save_model(model, f"{base}/model", version)
    weights = model.stages[-1]
    importances = None
    if hasattr(weights, "featureImportances"):
        names = [*numeric, *categorical]
        importances = {r["feature"]: r["importance"] for r in feature_importance(model, names).collect()}
    record_model(spark, f"{base}/model", version, model_type, model_path, metrics.first().asDict(), importances)

    served = serving.materialize(offline.get_dataset(dataset, version), "features", entity, [*numeric, *categorical])
    serving.sync_from(offline, dataset, "inference", entity, version)
    return TrainingResult(model, model_path, metrics, confusion_matrix(scored), classification_report(scored), checked, path, served)


def training_from_wide(spark: SparkSession, wide: DataFrame, numeric: Sequence[str], categorical: Sequence[str], base: str,
                       order: Sequence[str], year: str = "all", preparation: dict | None = None, **settings) -> TrainingResult:
    """The whole job from the wide, year-suffixed table: prepare, label, number the rows in ``order``, train.

    The label comes from the prepared rows; ``preparation`` goes to ``prepare_dataset``, other settings
    to ``training_job``.
    """
    rows = with_entity_id(create_label(prepare_dataset(wide, year, **(preparation or {}))), order)
    return training_job(spark, rows, "entity_id", TARGET, numeric, categorical, base, **settings)
