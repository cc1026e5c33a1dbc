"""Alert rows derived from drift results and other events, and their history."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelake.functions.ordering import tail_rows
from featurelake.functions.scalars import truncate_text

# Alert types, severities, severity limits, history size and titles.
ALERT_TYPES = ["data_drift", "prediction_drift", "model_performance", "model_promoted", "training_complete",
               "training_failed", "api_error", "system_error", "custom"]
SEVERITIES = ["info", "warning", "error", "critical"]
DATA_DRIFT_ERROR_RATIO, PREDICTION_DRIFT_ERROR_SCORE = 0.5, 0.3
HISTORY_SHOWN = 100
DATA_DRIFT_TITLE, PREDICTION_DRIFT_TITLE = "Data Drift Detected", "Prediction Drift Detected"
CLASS_SHARE_TITLE = "Prediction distribution out of bounds"
PERFORMANCE_TITLE, PROMOTION_TITLE = "Performance Degradation", "Model Promoted"
TRAINING_DONE_TITLE, TRAINING_FAILED_TITLE, API_ERROR_TITLE = "Training Completed", "Training Failed", "API Error"


def alert(alert_type: str, severity: str | Column, title: Column | str, message: Column,
          metadata: Mapping[str, Column], timestamp: Column, source: str = "featurelake") -> Column:
    """One alert as a struct; type and literal severity are checked."""
    if alert_type not in ALERT_TYPES:
        raise ValueError(f"unknown alert type {alert_type!r}")
    if isinstance(severity, str) and severity not in SEVERITIES:
        raise ValueError(f"unknown severity {severity!r}")
    entries = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    meta = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    return F.struct(
        F.lit(alert_type).alias("alert_type"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        (F.lit(title) if isinstance(title, str) else title).alias("title"), message.alias("message"),
        timestamp.alias("timestamp"), meta.alias("metadata"), F.lit(source).alias("source"))


def data_drift_alert(timestamp: Column, names: Column | None = None) -> Column:
    """Over a drift summary row; ``names`` holds the names of the drifted features as one text."""
    found, seen, ratio = F.col("features_with_drift"), F.col("features_analyzed"), F.col("drift_ratio")
    text = F.format_string("Drift detected in %d of %d features (%.1f%% affected)", found, seen, ratio * 100)
    severity = F.when(ratio < DATA_DRIFT_ERROR_RATIO, "warning").otherwise("error")
    return alert("data_drift", severity, DATA_DRIFT_TITLE, text,
                 {"drift_ratio": ratio} | ({} if names is None else {"features": names}), timestamp)


def prediction_drift_alert(timestamp: Column, expected: float = 0.5) -> Column:
    """Over a prediction drift row."""
    share, score = F.col("class_1_share"), F.col("drift_score")
    exact = F.col("exact_score")  # the limit is met by the score itself, not by its rounded form
    text = F.format_string("Class 1 share %.1f%% instead of %.1f%%, drift score %.4f",
                           share * 100, F.lit(expected * 100), score)
    severity = F.when(exact < PREDICTION_DRIFT_ERROR_SCORE, "warning").otherwise("error")
    return alert("prediction_drift", severity, PREDICTION_DRIFT_TITLE, text, {
        "sample_size": F.col("sample_size"), "class_0_share": F.col("class_0_share"), "class_1_share": share,
        "expected_share": F.lit(expected), "drift_score": score}, timestamp)


def class_share_alert(timestamp: Column, bounds: tuple[float, float]) -> Column:
    """Over a class share row (total, class_1_count, class_1_ratio)."""
    low, high = (F.lit(b) for b in bounds)
    text = F.format_string("Class 1 share is %.2f%%, expected between %.2f%% and %.2f%%", F.col("class_1_ratio") * 100, low * 100, high * 100)
    return alert("custom", "warning", CLASS_SHARE_TITLE, text, {
        "total_predictions": F.col("total"), "class_1_count": F.col("class_1_count"),
        "class_1_ratio": F.col("class_1_ratio"), "class_1_min": low, "class_1_max": high}, timestamp)


def alerts_from_drift(summary: DataFrame, predictions: DataFrame, timestamp: Column,
                      features: DataFrame | None = None) -> DataFrame:
    """Alert rows for those results that drifted; a table of drift features adds their names."""
    names = None
    if features is not None:
        # One row per column of the inputs, so the list is short.
        drifted = features.agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("drift"), F.col("feature")))), ",").alias("names"))
        summary, names = summary.join(drifted.withColumn("drift_detected", F.lit(True)), "drift_detected"), F.col("names")
    data = summary.where("drift_detected").select(data_drift_alert(timestamp, names).alias("a"))
    if "exact_score" not in predictions.columns:
        predictions = predictions.withColumn("exact_score", F.col("drift_score"))
    pred = predictions.where("drift_detected").select(prediction_drift_alert(timestamp).alias("a"))
    return data.unionByName(pred).select("a.*")


def feature_drift_alert(timestamp: Column, threshold: float) -> Column:
    """Over a drift feature row (feature, z_score)."""
    score = F.col("z_score")
    return alert("data_drift", "warning", F.concat(F.lit(f"{DATA_DRIFT_TITLE}: "), F.col("feature")),
                 F.format_string("Feature %s scored %.4f, limit %.2f", F.col("feature"), score, F.lit(threshold)),
                 {"feature": F.col("feature"), "drift_score": score, "threshold": F.lit(threshold),
                  "exceeded_by": F.round(score - threshold, 4)}, timestamp)


def performance_alert(metric: Column, current: Column, expected: Column, timestamp: Column) -> Column:
    return alert("model_performance", "warning", F.concat(F.lit(f"{PERFORMANCE_TITLE}: "), metric),
                 F.format_string("Metric %s is %.4f, expected %.4f", metric, current, expected),
                 {"metric": metric, "current_value": F.round(current, 4), "expected_value": F.round(expected, 4),
                  "difference": F.round(expected - current, 4)}, timestamp)


def promotion_alert(model: Column, version: Column, stage: Column, timestamp: Column, metrics: Mapping[str, Column] | None = None) -> Column:
    """A promotion, with the promoted version's metrics under their own names."""
    return alert("model_promoted", "info", F.concat(F.lit(f"{PROMOTION_TITLE}: "), model),
                 F.concat(model, F.lit(" version "), version.cast("string"), F.lit(" is now in "), stage),
                 {"model_name": model, "version": version, "stage": stage, **(metrics or {})}, timestamp)


def training_complete_alert(model: Column, seconds: Column, metrics: Mapping[str, Column], timestamp: Column) -> Column:
    return alert("training_complete", "info", F.concat(F.lit(f"{TRAINING_DONE_TITLE}: "), model),
                 F.format_string("%s trained in %.1f s", model, seconds),
                 {"model_name": model, "duration_seconds": F.round(seconds, 1),
                  **{f"metric_{k}": F.round(v, 4) for k, v in metrics.items()}}, timestamp)


def training_failed_alert(model: Column, error: Column, timestamp: Column) -> Column:
    return alert("training_failed", "error", F.concat(F.lit(f"{TRAINING_FAILED_TITLE}: "), model),
                 F.concat(F.lit("Training failed for "), model),
                 {"model_name": model, "error": truncate_text(error)}, timestamp)


def api_error_alert(endpoint: Column, error: Column, status: Column, timestamp: Column) -> Column:
    return alert("api_error", "error", F.concat(F.lit(f"{API_ERROR_TITLE}: "), endpoint),
                 F.concat(F.lit("Error on "), endpoint, F.lit(": "), error),
                 {"endpoint": endpoint, "error": truncate_text(error), "status_code": status}, timestamp)


def alert_history(alerts: DataFrame, ts: str, tie: str, alert_type: str | None = None, severity: str | None = None,
                  limit: int = HISTORY_SHOWN, kept: int | None = None) -> DataFrame:
    """Last ``limit`` alerts of a type and severity; with ``kept`` only among so many newest ones."""
    rows = alerts if kept is None else tail_rows(alerts, kept, ts, tie)
    if alert_type is not None:
        rows = rows.where(F.col("alert_type") == alert_type)
    if severity is not None:
        rows = rows.where(F.col("severity") == severity)
    return rows.orderBy(F.desc(ts), F.desc(tie)).limit(limit)
