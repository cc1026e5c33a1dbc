"""Batch scoring."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelake.operators.features import scoring_defaults
from featurelake.operators.predictions import label_text
from featurelake.session import on_all_cores
from featurelake.sources.serving import ServingStore


def score_columns(p1: Column, prediction: Column, version: str, source: str) -> dict[str, Column]:
    """Output fields of a scored row; probabilities and confidence have four decimals."""
    p0 = 1 - p1
    return {
        "prediction": prediction.cast("int"),
        "label": label_text(prediction),
        "probability_no_turning_point": F.round(p0, 4),
        "probability_turning_point": F.round(p1, 4),
        "confidence": F.round(F.greatest(p0, p1), 4),
        "model_version": F.lit(version),
        "loaded_from": F.lit(source),
    }


def score_batch(model, df: DataFrame, version: str, source: str = "file", key: str | None = None,
                defaults: list[str] | None = None) -> DataFrame:
    """Score every row in one plan; each result carries a prediction id.

    ``defaults`` are numeric inputs to create when the frame lacks them. Without a ``key`` ids
    are random.
    """
    ready = scoring_defaults(df, defaults) if defaults is not None else df
    scored = model.transform(on_all_cores(ready))
    p1 = F.element_at(vector_to_array("probability"), 2)
    out = scored.withColumns(score_columns(p1, F.col("prediction"), version, source))
    pid = F.uuid() if key is None else F.col(key).cast("string")
    return out.withColumn("prediction_id", pid).drop("features", "rawPrediction", "probability")


def score_by_ids(model, store: ServingStore, table: str, ids: DataFrame, version: str,
                 defaults: list[str] | None = None) -> DataFrame:
    """Look the entities up and score them; ids without features yield no row."""
    rows = store.get_features(table, ids)
    return score_batch(model, rows, version, "serving", rows.columns[0], defaults)


def linear_score(df: DataFrame, coefficients: Mapping[str, float], intercept: float) -> Column:
    """Class-1 probability of a fixed logistic model; missing inputs count as 0."""
    z = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(float(w)) for c, w in coefficients.items()),
            F.lit(float(intercept)))
    return 1 / (1 + F.exp(-z))
