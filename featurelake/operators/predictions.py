"""Analytics over the prediction log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurelake.functions.histogram import CONFIDENCE_BOUNDS, equal_width_bin
from featurelake.functions.ordering import global_index, overlap_buckets, tail_rows
from featurelake.functions.scalars import clamp, ratio_or_zero, safe_ratio

# Label texts, rolling frame and its reference lines, short-window rule.
LABEL_TEXTS = {1: "Ponto de Virada Provável", 0: "Ponto de Virada Improvável"}
ROLLING_FRAME = 50
REFERENCE_LINES = {"baseline": 0.5, "lower": 0.3, "upper": 0.7}
SHORT_WINDOW, SHORT_MINIMUM, SHORT_DISTANCE = 100, 10, 0.2


def label_text(prediction, texts: dict[int, str] = LABEL_TEXTS):
    return F.when(prediction == 1, F.lit(texts[1])).otherwise(F.lit(texts[0]))


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def daily_counts(df: DataFrame, ts: str = "ts", label: str = "label") -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day"), label).agg(F.count(F.lit(1)).alias("n"))


def confidence_histogram(df: DataFrame, confidence: str = "confidence", label: str = "label",
                         bins: int = 20) -> DataFrame:
    """Counts per label on a fixed grid over [0, 1]; empty bins have no row."""
    return df.where(F.col(confidence).isNotNull()).groupBy(
        label, equal_width_bin(F.col(confidence), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def confidence_cumulative(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    """Cumulative counts per upper bound, the open one last; a single aggregate row unfolded."""
    value = clamp(F.col(confidence), 0.0, 1.0)
    aggs = [F.count_if(value <= b).alias(f"n{i}") for i, b in enumerate(CONFIDENCE_BOUNDS)]
    aggs.append(F.count(value).alias(f"n{len(CONFIDENCE_BOUNDS)}"))
    names = [str(b) for b in CONFIDENCE_BOUNDS] + ["+Inf"]
    return df.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("le"), F.col(f"n{i}").alias("n")) for i, name in enumerate(names)])))


def prediction_distribution(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    total = F.count(F.lit(1))
    zeros, ones = F.count_if(F.col(prediction) == 0), F.count_if(F.col(prediction) == 1)
    return df.agg(
        total.alias("total_predictions"), zeros.alias("class_0"), ones.alias("class_1"),
        F.round(safe_ratio(zeros * 100.0, total), 2).alias("class_0_pct"),
        F.round(safe_ratio(ones * 100.0, total), 2).alias("class_1_pct"))


def latest(df: DataFrame, ts: str = "ts", tie: str = "prediction_id", n: int = 10) -> DataFrame:
    return tail_rows(df, n, ts, tie)


def recent_class_ratio(df: DataFrame, ts: str = "ts", tie: str = "prediction_id", prediction: str = "prediction",
                       n: int = SHORT_WINDOW, minimum: int = SHORT_MINIMUM,
                       distance: float = SHORT_DISTANCE) -> DataFrame:
    """Class-1 share of the last ``n`` rows; no row unless the log holds more than ``minimum``."""
    share = ratio_or_zero(F.count_if(F.col(prediction) == 1), F.count(F.lit(1)))
    off = F.abs(share - REFERENCE_LINES["baseline"])
    return tail_rows(df, n, ts, tie).agg(
        F.count(F.lit(1)).alias("analyzed"), F.round(share, 4).alias("class_1_ratio"),
        F.round(share - REFERENCE_LINES["baseline"], 4).alias("delta"), (off > distance).alias("possible_drift")
    ).where(F.col("analyzed") > minimum)


def rolling_class_ratio(df: DataFrame, ts: str = "ts", tie: str = "prediction_id", prediction: str = "prediction",
                        frame: int = ROLLING_FRAME, width: int = 100_000) -> DataFrame:
    """Class-1 share of the ``frame`` rows before each row, for rows that have that many.

    Rows get a global position; buckets of consecutive positions carry the last ``frame`` rows of
    the bucket before them, so every window is bounded and the axis is spread over all tasks.
    """
    indexed = global_index(df.select(ts, tie, prediction), [F.col(ts), F.col(tie)], "idx")
    placed = overlap_buckets(indexed, F.col("idx"), max(width, frame), frame)
    before = Window.partitionBy("bucket").orderBy("idx").rowsBetween(-frame, -1)
    ratio = F.round(F.avg(F.col(prediction).cast("double")).over(before), 4)
    return (
        placed.withColumn("class_1_ratio", ratio)
        .where(~F.col("is_copy") & (F.col("idx") >= frame))
        .select(tie, "idx", "class_1_ratio",
                F.col("class_1_ratio").between(REFERENCE_LINES["lower"], REFERENCE_LINES["upper"]).alias("in_bounds"))
    )


def join_feedback(feedback: DataFrame, predictions: DataFrame, key: str = "prediction_id", ts: str = "ts",
                  recent: int | None = None) -> DataFrame:
    """Feedback with its prediction's class and correctness; unmatched rows stay, correctness null.

    The first logged prediction of an id counts. All predictions can match; with ``recent`` only the
    last so many.
    """
    scope = predictions if recent is None else tail_rows(predictions, recent, ts, key)
    first = scope.groupBy(key).agg(F.min_by("prediction", ts).alias("prediction"))
    return feedback.join(first, key, "left").withColumn(
        "was_correct", F.col("prediction") == F.col("actual_outcome"))


def production_accuracy(matched: DataFrame) -> DataFrame:
    """Share of correct ones among matched feedback; 0 when none matched."""
    known, right = F.count("was_correct"), F.count_if(F.col("was_correct"))
    return matched.agg(known.alias("total_feedbacks"), right.alias("correct_predictions"),
                       F.round(ratio_or_zero(right, known), 4).alias("production_accuracy"))
