"""Mixing sources to target weights by systematic sampling.

``source_targets`` shares all words among the sources by weight; no source gets more than ``most`` times its size, and
what it cannot take is shared anew among the others. ``mix`` gives every document its number of copies: within a source
the expected copies (target / size of the source, the same for each document) are summed up along a fixed order, one
offset between 0 and 1 is added, and a document is emitted once for each integer boundary that its stretch crosses.

The order within a source is by size class (power of two), then a bucket (id modulo their number), then size and id, so that long and short
documents are drawn alike and the words taken come near the target. The prefix sum is taken in two steps: counts per
(source, size class, bucket), a running sum over those few cells, and ranks within a cell. No task ever holds a source.

Arithmetic is in whole parts of 10**-12: copies of rank r (from 1) are floor(r*t + u) - floor((r-1)*t + u) with
t = target/size, and u from a digest of the source, so reruns agree on any partitioning. A document has at most
ceil(t) copies, so at most ``most`` times its size.

Defined results: a null text has size 0; null sources form one source, last in order; sources are ordered by code point.
A document of size 0 may get copies, which take 0 words. A source of size 0 has target 0 and its documents no copies.
Repeated rows are separate documents of equal rank order, so the result is the same whichever comes first. Extra columns
are left out by ``mix`` and kept by ``mixed_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurelake.session import cut_lineage

#: Weights of the sources in order, repeating; times its size that a source or document may be taken; buckets.
WEIGHTS, MOST, BUCKETS = (5, 2, 1), 3, 256
#: Parts of a copy in which the sums are counted.
UNIT = 10**12


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows, one per source (source, source_size and others), with target.

    Sources that stop at their limit are a prefix in the order of size/weight: with k sources stopped, the rest shares
    what remains in one proportion, and k is right when the next source stays within its limit. That is where resharing
    the excess ends. The frame has a row per source, so its windows are small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    repeated = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    weighed = sizes.withColumn("weight", repeated)
    tight = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    shares = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = left / shares
    stopped = level * F.col("weight") > most * F.col("source_size")
    ranked = weighed.select("*", level.alias("level"), stopped.alias("stopped"))
    # The first source that stays within its limit gives the proportion of all that follow.
    final = F.min(F.when(~F.col("stopped"), F.struct(F.col("source_size") / F.col("weight"), F.col("level")))).over(everything)["level"]
    ratio = F.when(F.col("stopped"), (most * F.col("source_size")).cast("double")).otherwise(final * F.col("weight"))
    return ranked.select(*sizes.columns, F.least(ratio, (most * F.col("source_size")).cast("double")).alias("target"))


def copies(rows: DataFrame, buckets: int = BUCKETS, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows (doc_id, source, size and others) with source_size, target and copies."""
    cell = ["__source", "__class", "__bucket"]
    size = F.col("size").cast("double")
    placed = (rows.withColumn("__source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
              .withColumn("__class", F.when(size > 0, F.floor(F.log2(size))).otherwise(-1))
              .withColumn("__bucket", F.coalesce(F.pmod("doc_id", F.lit(buckets)), F.lit(-1))))
    cells = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"), F.sum("size").alias("__words"),
                                      F.min("source").alias("source"))
    sizes = cells.groupBy("__source").agg(F.sum("__words").alias("source_size"), F.min("source").alias("source"))
    running = Window.partitionBy("__source").orderBy("__class", "__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (cells.select(*cell, F.coalesce(F.sum("__n").over(running), F.lit(0)).alias("__start"))
              .join(source_targets(sizes, weights, most).select("__source", "source_size", "target"), "__source"))
    within = Window.partitionBy(*cell).orderBy("size", "doc_id")
    joined = placed.withColumn("__row", F.row_number().over(within)).join(starts, cell)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rate = F.floor(rate * UNIT).cast("decimal(15,0)")
    shift = F.conv(F.substring(F.md5(F.concat(F.lit("mix"), F.col("__source"))), 1, 8), 16, 10).cast("double")
    shift = F.floor(shift / 2**32 * UNIT).cast("decimal(15,0)")
    numbered = joined.select("*", (F.col("__start") + F.col("__row")).cast("decimal(16,0)").alias("__rank"),
                             rate.alias("__rate"), shift.alias("__shift"))
    crossed = F.expr(f"(__rank * __rate + __shift) div {UNIT}BD - ((__rank - 1BD) * __rate + __shift) div {UNIT}BD")
    return numbered.withColumn("copies", crossed).drop(*cell, "__row", "__start", "__rank", "__rate", "__shift")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document."""
    rows = cut_lineage(docs.select("doc_id", "source", word_count().alias("size")))  # words are counted once
    return (copies(rows).withColumn("taken", F.col("copies") * F.col("size"))
            .select("doc_id", "source", "size", "source_size", "target", "copies", "taken"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of the mix: each document as often as it is taken, with its own columns only."""
    packed = docs.select("doc_id", "source", word_count().alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    taken = copies(packed).filter("copies > 0")
    return taken.select("__doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__doc.*")
