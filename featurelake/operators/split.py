"""Exact stratified splits, folds and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurelake.functions.ordering import hash_parts

# Hold-out share, fold count and seed.
TEST_SHARE, FOLDS, SEED = 0.2, 5, 42


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = TEST_SHARE,
                     seed: int = SEED) -> DataFrame:
    """``split`` = test for exactly round(n * share) rows of each class, else train."""
    cut = F.round(F.col("n") * F.lit(test_share)).cast("bigint")
    parts = hash_parts(df, label, key, [cut], seed, "__part")
    return parts.withColumn("split", F.when(F.col("__part") == 0, "test").otherwise("train")).drop("__part")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """``fold`` 0..folds-1; within a class the fold sizes differ by at most one."""
    cuts = [F.floor(F.col("n") * F.lit(i) / F.lit(folds)).cast("bigint") for i in range(1, folds)]
    return hash_parts(df, label, key, cuts, seed, "fold")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight n / (k * n_class); one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # The window sees one row per class, not the data.
    every = Window.partitionBy()
    total, classes = F.sum("n").over(every), F.count(F.lit(1)).over(every)
    return counts.select(label, "n", (total / (classes * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Balanced weight per row of a binary label; a row without a label has no weight and counts for none.

    The class counts are one row per class; a third class is an error.
    """
    weights = {r[label]: r["weight"] for r in class_weights(df.where(F.col(label).isNotNull()), label).limit(3).collect()}
    if len(weights) > 2:
        raise ValueError(f"{label!r} is not a binary label")
    weight = F.lit(None).cast("double")
    for value, w in weights.items():
        weight = F.when(F.col(label) == value, F.lit(float(w))).otherwise(weight)
    return df.withColumn(name, weight)
