"""Online work as batches: score and log, take feedback and log it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelake.operators.predictions import join_feedback
from featurelake.operators.score import score_batch
from featurelake.session import cut_lineage
from featurelake.sources import logs
from featurelake.sources.serving import ServingStore


def score_and_log(model, rows: DataFrame, inputs: Sequence[str], log_path: str, version: str, source: str = "file",
                  defaults: list[str] | None = None) -> DataFrame:
    """Score a batch under fresh prediction ids and append every score, with its inputs, to the log.

    The scored rows are stored before anything reads them: ids are random and must not differ
    between the log and the answer.
    """
    scored = cut_lineage(
        score_batch(model, rows, version, source, defaults=defaults).withColumn("timestamp", F.current_timestamp()))
    logs.append_log(logs.prediction_records(scored, list(inputs)), log_path)
    return scored


def score_ids_and_log(model, store: ServingStore, table: str, ids: DataFrame, inputs: Sequence[str], log_path: str,
                      version: str, defaults: list[str] | None = None) -> DataFrame:
    """The same for entities looked up by id; the log holds their features, not just the id."""
    return score_and_log(model, store.get_features(table, ids), inputs, log_path, version, "serving", defaults)


def feedback_and_log(spark: SparkSession, feedback: DataFrame, prediction_log: str, feedback_log: str,
                     recent: int | None = None) -> DataFrame:
    """Match outcomes to logged predictions, append all of them to the feedback log, return them."""
    log = logs.read_log(spark, prediction_log, logs.PREDICTION_SCHEMA).where(
        F.col("output.prediction_id").isNotNull()).select(
        F.col("output.prediction_id").alias("prediction_id"), F.col("timestamp").alias("ts"),
        F.col("output.prediction").alias("prediction"))
    matched = cut_lineage(
        join_feedback(feedback, log, recent=recent).withColumn("timestamp", F.current_timestamp()))
    logs.append_log(logs.feedback_records(matched), feedback_log)
    return matched
