"""Tree models trained on cells: rows that no split can tell apart are one weighted row.

A tree asks of a feature only on which side of a split candidate it lies, and there are ``maxBins`` - 1 candidates at most. Rows of
equal label that lie between the same candidates in every feature therefore go the same way in every tree. They are counted in one
aggregation over all rows, and trees train on the counts: ``2 * maxBins ** features`` cells at most, however many rows there are.

Candidates lie half way between neighbours of ``maxBins`` values of a feature, its quantiles over all rows; a feature of no more
values keeps them all. A cell carries these values, so that Spark's trees find the same candidates between them.

Boosting weighs a cell by its rows, which is what it does with the rows themselves. A forest's trees each draw their own bootstrap: a
row comes Poisson(1) times into a tree's sample, hence a cell of n rows Poisson(n) times. Draws depend on the seed and the cell alone.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Sequence
from functools import reduce
from itertools import accumulate
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, StorageLevel, inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelake.session import cut_lineage, on_all_cores

# Quantiles asked of each feature and class, and rows a quantile may be off, as a share.
QUANTILES, ACCURACY = 2048, 10_000
# Cells pay from so many rows each: a cell costs a forest about eight times a row's time. More features make too many cells to try.
ROWS_A_CELL, MOST_FEATURES = 8, 12
# Cells one task trains a tree on.
CELLS_A_TASK = 200_000
# Trees that ask for tasks at the same time, for each core: while the driver plans one tree's next pass, the core works for another.
AHEAD = 2


def values_of(points: Sequence[tuple[float, float]], most: int) -> list[float]:
    """At most ``most`` rising values for weighted ``points`` (value, mass): all there are, or quantiles in the middle of equal parts.

    A value stays only if the point half way to the one before lies between the two.
    """
    points = sorted(points)
    found = sorted({v for v, _ in points})
    if len(found) > most:
        sums = list(accumulate(m for _, m in points))
        found = [points[min(bisect_left(sums, sums[-1] * (i + 0.5) / most), len(points) - 1)][0] for i in range(most)]
    out: list[float] = []
    for value in found:
        if not out or out[-1] < (out[-1] + value) / 2 < value:
            out.append(value)
    return out


def flat(ready: DataFrame, width: int) -> DataFrame:
    """label, weight, x0, x1, ... of rows with features, or the rows themselves if they are so already."""
    if "features" not in ready.columns:
        return ready
    x = ready.select("label", "weight", vector_to_array("features").alias("x"))
    return x.select("label", "weight", *[F.col("x")[i].alias(f"x{i}") for i in range(width)])


def feature_values(ready: DataFrame, width: int, most: int) -> list[list[float]] | None:
    """The values that stand for each feature's cells, from all rows with label, weight and features; None if some are not finite or
    labels are not 0 and 1, which is left to Spark's own checks.

    A feature of no more values than quantiles are asked for is counted by value, which costs far less than its quantiles.
    """
    rows = flat(ready, width)
    classes = {r["label"]: r for r in rows.groupBy("label").agg(  # a row for each class
        F.sum("weight").alias("mass"), F.count(F.lit(1)).alias("rows"),
        *[F.approx_count_distinct(f"x{i}").alias(f"n{i}") for i in range(width)]).collect()}
    if set(classes) != {0, 1}:
        return None
    points: list[list[tuple[float, float]]] = [[] for _ in range(width)]
    few = [i for i in range(width) if max(r[f"n{i}"] for r in classes.values()) <= QUANTILES]
    many = [i for i in range(width) if i not in few]
    if few:
        listed = [rows.groupBy("label", F.lit(i).alias("feature"), F.col(f"x{i}").alias("value")).count() for i in few]
        for r in reduce(DataFrame.unionByName, listed).collect():
            of = classes[r["label"]]
            points[r["feature"]].append((math.nan if r["value"] is None else r["value"], (of["mass"] or 0.0) * r["count"] / of["rows"]))
    if many:
        asked = [i / QUANTILES for i in range(QUANTILES + 1)]
        for r in rows.groupBy("label").agg(*[F.percentile_approx(f"x{i}", asked, ACCURACY).alias(f"q{i}") for i in many]).collect():
            for i in many:
                points[i] += [(v, classes[r["label"]]["mass"] or 0.0) for v in r[f"q{i}"] or [math.nan]]
    if not all(math.isfinite(v) for listed in points for v, _ in listed):
        return None
    return [values_of(listed, most) for listed in points]


def counted(ready: DataFrame, values: Sequence[Sequence[float]]) -> DataFrame:
    """label, weight, cell (a hash), x0, x1, ... and the number of rows of every cell that has rows.

    A row at a candidate lies below it, as in a tree. A bucketizer puts it above, so it sees the rows' negatives.
    """
    rows = flat(ready, len(values)).select("label", "weight", *[(-F.col(f"x{i}")).alias(f"n{i}") for i in range(len(values))])
    wide = [i for i, v in enumerate(values) if len(v) > 1]
    if wide:
        splits = [[-math.inf, *[-(a + b) / 2 for a, b in zip(values[i][-2::-1], values[i][:0:-1])], math.inf] for i in wide]
        rows = Bucketizer(splitsArray=splits, inputCols=[f"n{i}" for i in wide], outputCols=[f"b{i}" for i in wide]).transform(rows)
    keys = ["label", "weight", *[f"b{i}" for i in wide]]
    cells = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    stands = [F.element_at(F.array(*map(F.lit, v[::-1])), F.col(f"b{i}").cast("int") + 1) if i in wide else F.lit(v[0])
              for i, v in enumerate(values)]
    return cells.select("label", "weight", F.xxhash64(*keys).alias("cell"), "rows", *[s.alias(f"x{i}") for i, s in enumerate(stands)])


def cells_of(ready: DataFrame, rows: int, most: int) -> DataFrame | None:
    """Stored cells of the rows, or None where cells do not pay: many features, few rows a cell, or values that are not numbers.

    The rows are dealt to all cores and held on disk while they are looked at twice.
    """
    attributes = ready.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    if "nominal" in attributes or "binary" in attributes:
        return None
    first = ready.select(F.size(vector_to_array("features")).alias("n")).first()
    if first is None or first["n"] is None or not 0 < first["n"] <= MOST_FEATURES:
        return None
    held = on_all_cores(flat(ready, first["n"])).persist(StorageLevel.DISK_ONLY)
    try:
        values = feature_values(held, first["n"], most)
        if values is None:
            return None
        cells = cut_lineage(counted(held, values))
    finally:
        held.unpersist()
    return cells if cells.count() * ROWS_A_CELL <= rows else None


def weighted(cells: DataFrame, count, least: int) -> DataFrame:
    """label, weight, features of cells with features that count for ``count`` rows, each as ``least`` rows or, of fewer, as all.

    So a node has ``least`` rows here if and only if it has as many of those counted.
    """
    classes = {"ml_attr": {"type": "nominal", "vals": ["0", "1"]}}
    label, weight = F.col("label").cast("double").alias("label", metadata=classes), F.col("weight") * count
    if least == 1:
        return cells.where(count > 0).select(label, weight.alias("weight"), "features")
    parts = F.least(F.lit(least), count)
    return cells.where(count > 0).select(
        label, (weight / parts).alias("weight"), "features", F.explode(F.array_repeat(F.lit(0), parts.cast("int")))).drop("col")


def least_weight(low: float, high: float, least: int) -> float | None:
    """A weight that ``least`` rows reach and fewer do not, rows weighing from ``low`` to ``high``; None if there is none."""
    return ((least - 1) * high + least * low) / 2 if 0 < (least - 1) * high < least * low else None


def drawn(rate: float, trees: int, replaced: bool, seed: int):
    """How often a cell's rows come into each tree's sample."""

    @F.pandas_udf("array<long>")
    def draw(cell, rows):
        import numpy as np
        import pandas as pd

        out = []
        for c, n in zip(cell, rows):
            random = np.random.default_rng([seed % 2**32, c % 2**64])
            out.append(random.poisson(rate * n, trees) if replaced else random.binomial(n, rate, trees))
        return pd.Series(out)

    return draw


def bins_for(examples: int, least: int) -> int:
    """A limit of bins at which Spark looks for candidates in all examples instead of a sample; each feature still has only its own."""
    return max(least, math.isqrt(max(examples, 1)) + 1)


def share_to_ask(cells: DataFrame, rate: float) -> float:
    """Share of a tree's examples that holds every value of every feature, but for a chance of exp(-40) each.

    A cell is in a tree's sample by a chance of 1 - exp(-rate) at least, so the value of fewest cells decides.
    """
    names = [c for c in cells.columns if c.startswith("x")]
    found = cells.select(F.posexplode(F.array(*names)).alias("feature", "value")).groupBy("feature", "value").count()
    return min(1.0, 40 / (found.agg(F.min("count")).first()[0] * -math.expm1(-rate)))


def assembled(cells: DataFrame) -> DataFrame:
    """Cells with their values as features."""
    return VectorAssembler(inputCols=[c for c in cells.columns if c.startswith("x")], outputCol="features").transform(cells)


def boosted(cells: DataFrame, classifier):
    """Fitted boosting classifier; the cells' weights are those of one row."""
    least = classifier.getMinInstancesPerNode()
    n = cells.count()
    tasks = max(1, math.ceil(n * min(least, 2) / CELLS_A_TASK), cells.sparkSession.sparkContext.defaultParallelism // 2)
    rows = weighted(assembled(cells), F.col("rows"), least).repartition(tasks)
    return classifier.copy({classifier.weightCol: "weight", classifier.maxBins: bins_for(n * least, classifier.getMaxBins())}).fit(rows)


def forest(cells: DataFrame, classifier):
    """Fitted forest: each tree is fitted by Spark on its own sample, several at a time, and all make one model."""
    spark = cells.sparkSession
    cores, trees, least = spark.sparkContext.defaultParallelism, classifier.getNumTrees(), classifier.getMinInstancesPerNode()
    rate, replaced, subset = classifier.getSubsamplingRate(), classifier.getBootstrap(), classifier.getFeatureSubsetStrategy()
    if subset == "auto":
        subset = "sqrt" if trees > 1 else "all"
    found = cells.agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("low"), F.max("weight").alias("high")).first()
    limit = least_weight(found["low"], found["high"], least)
    sampled = assembled(cells.repartition(cores)).withColumn("taken", drawn(rate, trees, replaced, classifier.getSeed())("cell", "rows"))
    sampled = cut_lineage(sampled.select("label", "weight", "features", *[F.col("taken")[t].alias(f"t{t}") for t in range(trees)]))
    shares = [classifier.getMinWeightFractionPerNode()] * trees
    if limit is not None:  # a node's weight tells whether it has the rows, so one row stands for a cell
        totals = sampled.agg(*[F.sum(F.col("weight") * F.col(f"t{t}")) for t in range(trees)]).first()
        if all(total and limit / total < 0.5 for total in totals):
            least, shares = 1, [max(share, limit / total) for share, total in zip(shares, totals)]
    bins = bins_for(math.ceil(found["n"] * least * share_to_ask(cells, rate)), classifier.getMaxBins())
    tasks = max(1, math.ceil(found["n"] * least / CELLS_A_TASK))

    def one(t: int):
        single = RandomForestClassifier(
            featuresCol="features", labelCol="label", weightCol="weight", numTrees=1, bootstrap=False, subsamplingRate=1.0,
            featureSubsetStrategy=subset, seed=(classifier.getSeed() + t * 1_000_003) % 2**62, impurity=classifier.getImpurity(),
            maxDepth=classifier.getMaxDepth(), maxBins=bins, minInstancesPerNode=least,
            minInfoGain=classifier.getMinInfoGain(), minWeightFractionPerNode=shares[t],
            maxMemoryInMB=classifier.getMaxMemoryInMB())
        sample = weighted(sampled, F.col(f"t{t}"), least).coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return single.fit(sample)
        finally:
            sample.unpersist()

    pool = ThreadPool(min(trees, max(2, AHEAD * cores // tasks)))
    try:
        fitted = pool.map(inheritable_thread_target(spark)(one), range(trees), chunksize=1)
    finally:
        pool.close()
    return joined(classifier, fitted)


def joined(classifier, models: Sequence[RandomForestClassificationModel]) -> RandomForestClassificationModel:
    """One forest of all models' trees, with the classifier's settings."""
    context = SparkContext._active_spark_context
    trees = context._gateway.new_array(context._jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, len(models))
    for i, model in enumerate(models):
        trees[i] = model._java_obj.trees()[0]
    java = context._jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(
        classifier.uid, trees, models[0].numFeatures, models[0].numClasses)
    return classifier._copyValues(RandomForestClassificationModel(java))
