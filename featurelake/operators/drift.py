"""Data drift, prediction drift and their roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelake.functions.scalars import ratio_or_zero, safe_ratio
from featurelake.operators.profile import column_moments

# Z-score of a drifted feature, tolerated drift share, expected class shares, bounds.
Z_LIMIT = 2.0
DRIFT_THRESHOLD = 0.1
EXPECTED_CLASS_1 = 0.5
CLASS_1_BOUNDS = (0.10, 0.90)
RECENT_WINDOW = 1000


def _z_score() -> Column:
    """Over ref_mean, ref_std and cur_mean; 0 where it is undefined."""
    z = F.when(F.col("ref_std") > 0, F.abs(F.col("cur_mean") - F.col("ref_mean")) / F.col("ref_std"))
    return F.coalesce(F.when(~F.isnan(z), z), F.lit(0.0))


def _reference(stats: DataFrame) -> DataFrame:
    return stats.select("feature", F.col("mean").alias("ref_mean"), F.col("std").alias("ref_std"))


def drift_features(reference: DataFrame, current: DataFrame, z_limit: float = Z_LIMIT) -> DataFrame:
    """Mean shift per feature both sides have, in reference deviations.

    ``reference`` is a statistics table (feature, mean, std), ``current`` raw rows or such a table.
    A feature without spread, or without a current mean, scores 0 and does not drift.
    """
    now = current if {"feature", "mean"} <= set(current.columns) else column_moments(current)
    return (
        _reference(reference).join(now.select("feature", F.col("mean").alias("cur_mean")), "feature")
        .withColumn("z", _z_score())
        .select("feature", F.round("ref_mean", 4).alias("ref_mean"), F.round("cur_mean", 4).alias("cur_mean"),
                F.round("z", 4).alias("z_score"), (F.col("z") > z_limit).alias("drift"))
    )


def drift_summary(features: DataFrame, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """Analysed and drifted counts, their ratio, and the overall flag; no features means no drift."""
    analysed, drifted = F.count(F.lit(1)), F.count_if(F.col("drift"))
    return features.agg(analysed.alias("features_analyzed"), drifted.alias("features_with_drift")).withColumns({
        "drift_ratio": F.round(safe_ratio(F.col("features_with_drift"), F.col("features_analyzed")), 4),
        "drift_detected": F.coalesce(
            safe_ratio(F.col("features_with_drift"), F.col("features_analyzed")) > threshold, F.lit(False)),
    })


def prediction_drift(predictions: DataFrame, prediction: str = "prediction", expected: float = EXPECTED_CLASS_1,
                     threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """Distance of the class-1 share from the expected one, rounded and exact; an empty frame yields no row."""
    share = [F.avg(F.when(F.col(prediction) == k, 1.0).otherwise(0.0)).alias(f"s{k}") for k in (0, 1)]
    return prediction_drift_of(predictions.agg(F.count(F.lit(1)).alias("sample_size"), *share), expected, threshold)


def prediction_drift_of(shares: DataFrame, expected: float = EXPECTED_CLASS_1, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """Prediction drift of counted rows: sample_size and the classes' shares s0, s1."""
    score = F.abs(F.col("s1") - F.lit(expected))
    return shares.where(F.col("sample_size") > 0).select(
        "sample_size", F.round("s0", 4).alias("class_0_share"), F.round("s1", 4).alias("class_1_share"),
        F.round(score, 4).alias("drift_score"), score.alias("exact_score"), (score > threshold).alias("drift_detected"))


def recent_summary(recent: DataFrame, reference: DataFrame, inputs: Sequence[str], prediction: str = "prediction",
                   expected: float = EXPECTED_CLASS_1, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """Window analysis in one row: class counts, prediction drift and data drift of the inputs.

    ``inputs`` is the allow-list of model features; ids never count as one. A single aggregate over
    the window yields counts and input means together; no rows, no result.
    """
    total, share = F.count(F.lit(1)), ratio_or_zero(F.count_if(F.col(prediction) == 1), F.count(F.lit(1)))
    counts = {
        "window_size": total, "class_0_count": F.count_if(F.col(prediction) == 0),
        "class_1_count": F.count_if(F.col(prediction) == 1), "class_1_ratio": F.round(share, 4),
        "prediction_drift_score": F.round(F.abs(share - expected), 4),
        "prediction_drift": F.abs(share - expected) > threshold,
    }
    numbers = {c: F.col(c).cast("double") for c in inputs}
    means = [F.avg(F.when(~F.isnan(v), v)).alias(f"__mean{i}") for i, v in enumerate(numbers.values())]
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"__mean{i}").alias("cur_mean"))
                      for i, c in enumerate(inputs)])
    current = recent.agg(*[c.alias(n) for n, c in counts.items()], *means).where("window_size > 0").select(
        *counts, F.inline_outer(pairs))
    known = F.col("ref_mean").isNotNull()
    found, drifted = F.count_if(known), F.count_if(known & (_z_score() > Z_LIMIT))
    ratio = safe_ratio(F.col("features_with_drift"), F.col("features_analyzed"))
    return (
        current.join(_reference(reference), "feature", "left").groupBy(*counts)
        .agg(found.alias("features_analyzed"), drifted.alias("features_with_drift"))
        .withColumns({"drift_ratio": F.round(ratio, 4), "data_drift": F.coalesce(ratio > threshold, F.lit(False))})
    )


def drift_by_period(reference: DataFrame, df: DataFrame, period: str, inputs: Sequence[str], z_limit: float = Z_LIMIT,
                    threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """One drift summary per period, as ``drift_summary`` gives for each alone, from one aggregate over all rows."""
    means = [F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(f"__mean{i}") for i, c in enumerate(inputs)]
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"__mean{i}").alias("cur_mean")) for i, c in enumerate(inputs)])
    current = df.groupBy(period).agg(F.count(F.lit(1)).alias("n"), *means).select(period, "n", F.inline(pairs))
    analysed, drifted = F.count(F.lit(1)), F.count_if(_z_score() > z_limit)
    ratio = safe_ratio(F.col("features_with_drift"), F.col("features_analyzed"))
    # One row per period and input on one side, one per input on the other.
    return current.join(_reference(reference), "feature").groupBy(period, "n").agg(
        analysed.alias("features_analyzed"), drifted.alias("features_with_drift")).withColumns({
            "drift_ratio": F.round(ratio, 4), "drift_detected": F.coalesce(ratio > threshold, F.lit(False))})


def drift_report(events: DataFrame, ts: str, tie: str, last: int = 10, features: Sequence[str] | None = None,
                 threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """Newest drift events, each with the size of the whole history and its covered features.

    With ``features``, the features of the reference, every row also names them and the threshold.
    """
    total, covered = events.agg(F.count(F.lit(1)), F.max("features_analyzed")).first()
    report = events.orderBy(F.desc(ts), F.desc(tie)).limit(last).withColumns({
        "history_count": F.lit(total).cast("bigint"), "features_covered": F.lit(covered)})
    if features is None:
        return report
    return report.withColumns({"reference_features": F.array(*[F.lit(f) for f in features]), "drift_threshold": F.lit(float(threshold))})


def class_ratio_bounds(predictions: DataFrame, prediction: str = "prediction",
                       bounds: tuple[float, float] = CLASS_1_BOUNDS) -> DataFrame:
    """Whether the class-1 share leaves its bounds; without predictions it is not evaluated (null)."""
    total, ones = F.count(F.lit(1)), F.count_if(F.col(prediction) == 1)
    ratio = safe_ratio(F.col("class_1_count"), F.col("total"))
    return predictions.agg(total.alias("total"), ones.alias("class_1_count")).withColumns({
        "class_1_ratio": F.round(ratio, 6),
        "out_of_bounds": ~ratio.between(*bounds),
    })
