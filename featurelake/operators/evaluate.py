"""Exact binary classification metrics as aggregates."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurelake.functions.scalars import ratio_or_zero

# Rows to be put in order by one task of the ranks: each takes about 250 bytes there.
ROWS_A_BUCKET = 250_000
CELLS = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}


def _cell_counts(df: DataFrame, label: str, prediction: str, keys: list[str]) -> DataFrame:
    counts = [F.count_if((F.col(label) == y) & (F.col(prediction) == p)).alias(n) for n, (y, p) in CELLS.items()]
    return df.groupBy(*keys).agg(*counts) if keys else df.agg(*counts)


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """All four cells, empty ones as 0."""
    cells = F.array(*[
        F.struct(F.lit(y).alias("label"), F.lit(p).alias("prediction"), F.col(n).alias("n"))
        for n, (y, p) in CELLS.items()])
    return _cell_counts(df, label, prediction, []).select(F.inline(cells))


def _scores(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    return ratio_or_zero(tp, tp + fp), ratio_or_zero(tp, tp + fn), ratio_or_zero(2 * tp, 2 * tp + fp + fn)


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                   keys: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; a zero denominator gives 0."""
    keys = keys or []
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    precision, recall, f1 = _scores(tp, fp, fn)
    return _cell_counts(df, label, prediction, keys).select(
        *keys, F.round(ratio_or_zero(tp + tn, tp + tn + fp + fn), 4).alias("accuracy"),
        F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"),
        F.round(f1, 4).alias("f1_score"))


def score_cuts(df: DataFrame, score: str, buckets: int, most: int | None = None) -> list[float]:
    """At most ``buckets`` rising values that cut the scores into about equal parts, from one sketch; NaN and null are left out.

    A score that many rows share is a cut itself. If parts held more than ``most`` rows, a second sketch cuts into so many that
    they do not.
    """
    value = F.when(~F.isnan(F.col(score)), F.col(score).cast("double"))
    steps = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(value, steps, 20 * buckets).alias("cuts"), F.count(value).alias("n")).first()
    if most and found["n"] > most * buckets:
        return score_cuts(df, score, math.ceil(found["n"] / most))
    return sorted({v + 0.0 for v in found["cuts"] or [] if math.isfinite(v)})


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", keys: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Area under the ROC curve by rank sum, exact and with ties sharing their rank.

    The scores are cut into buckets by a sketch. Rows that score exactly a cut, however many, are counted where they are; those
    between two cuts move once, to their bucket, where distinct scores are put in order. There are as many buckets as shuffle
    partitions, or more, and as many tasks, so that none gets many more than ``ROWS_A_BUCKET`` rows. Buckets then add up their negatives. With
    ``keys`` every key has its own curve. A single class has no area (null). A null score is lower than all others, NaN
    higher.
    """
    keys = keys or []
    most = None if buckets else ROWS_A_BUCKET
    buckets = buckets or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = score_cuts(df, score, buckets, most)
    value = F.col(score).cast("double") + F.lit(0.0)  # minus zero is zero, also to a binary search
    narrow = df.select(*keys, value.alias("__score"), F.col(label).alias("__label"))
    placed = Bucketizer(splits=[-float("inf"), *(cuts or [0.0]), float("inf")], inputCol="__at", outputCol="__bucket").transform(
        narrow.withColumn("__at", F.when(F.isnan("__score") | F.col("__score").isNull(), 0.0).otherwise(F.col("__score"))))
    below = F.col("__bucket").cast("int")  # number of cuts at or below the score
    bounds = F.array(*[F.lit(c) for c in cuts or [0.0]])
    met = F.coalesce((below > 0) & (F.try_element_at(bounds, below) == F.col("__score")), F.lit(False))
    # Places in order: null, then open intervals (even) and cuts (odd) by turns, then NaN.
    place = (F.when(F.col("__score").isNull(), -1).when(F.isnan("__score"), 2 * len(cuts or [0.0]) + 1)
             .when(met, 2 * below - 1).otherwise(2 * below))
    placed = placed.select(*keys, "__score", "__label", place.alias("__place"))
    pos, neg = F.count_if(F.col("__label") == 1).alias("pos"), F.count_if(F.col("__label") == 0).alias("neg")
    single = F.pmod("__place", F.lit(2)) == 1
    points = placed.where(single).groupBy(*keys, "__place").agg(pos, neg).withColumn(
        "hits", F.col("pos").cast("double") * F.col("neg") / 2.0)
    # One move of the rows: both the counts and the order inside a bucket keep its partitioning.
    tasks = [len(cuts) + 1] if len(cuts) >= buckets else []
    moved = placed.where(~single).repartition(*tasks, F.col("__place"), *[F.col(k) for k in keys])
    scores = moved.groupBy(*keys, "__place", "__score").agg(pos, neg)
    inside = Window.partitionBy(*keys, "__place").orderBy("__score").rowsBetween(Window.unboundedPreceding, 0)
    spans = scores.withColumn("upto", F.sum("neg").over(inside)).groupBy(*keys, "__place").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("pos").cast("double") * (F.col("upto") - F.col("neg") / 2.0)).alias("hits"))
    # At most two rows for each cut, and key.
    order = Window.partitionBy(*keys).orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    summed = points.unionByName(spans).withColumn("before", F.coalesce(F.sum("neg").over(order), F.lit(0)))
    grouped = summed.groupBy(*keys) if keys else summed.groupBy()
    out = grouped.agg(F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("n"),
                      F.sum(F.col("hits") + F.col("pos").cast("double") * F.col("before")).alias("h"))
    return out.select(*keys, F.round(F.col("h") / F.nullif(F.col("p") * F.col("n"), F.lit(0.0)), 4).alias("roc_auc"))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class and averaged precision, recall, F1 and support; accuracy repeats over the scores."""
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    one, zero = _scores(tp, fp, fn), _scores(tn, fn, fp)
    ones, zeros = tp + fn, tn + fp
    total = ones + zeros
    accuracy = ratio_or_zero(tp + tn, total)
    macro = [(a + b) / 2 for a, b in zip(zero, one)]
    weighted = [ratio_or_zero(a * zeros + b * ones, total) for a, b in zip(zero, one)]

    def line(name: str, scores, support: Column) -> Column:
        p, r, f = (F.round(s, 4) for s in scores)
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1_score"),
                        support.alias("support"))

    rows = F.array(line("0", zero, zeros), line("1", one, ones), line("accuracy", [accuracy] * 3, total),
                   line("macro avg", macro, total), line("weighted avg", weighted, total))
    return _cell_counts(df, label, prediction, []).select(F.inline(rows))


def split_summary(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"),
                                 F.round(F.avg(F.col(label).cast("double")), 3).alias("positive_ratio"))
