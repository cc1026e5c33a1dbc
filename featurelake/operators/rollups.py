"""Statistics and distinct counts over any days from state stored by day."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelake.functions.ordering import EXACT_LIMIT, quantiles_at, present, rank_neighbours, values_at_ranks, values_in_brackets
from featurelake.functions.scalars import safe_ratio
from featurelake.operators.prepare import numeric_columns
from featurelake.sources.daily import DailyState

STATISTICS_SCHEMA = "feature string, n long, mean double, m2 double, low double, high double, sketch binary"
ACCESS_STATE_SCHEMA = "table_name string, bucket long, accesses long, bits binary"
#: Entries of a rank sketch, and the part of all rows that a bracket adds on each side of a rank; about three times the
#: sketch's usual error, and checked by counting.
SKETCH_K, MARGIN = 1600, 0.006
QUARTILES = (0.25, 0.5, 0.75)


# -- moments and quantiles ---------------------------------------------------------------------------


def statistics_state(spark: SparkSession, base: str) -> DailyState:
    return DailyState(spark, base, STATISTICS_SCHEMA)


def day_statistics(df: DataFrame, day: str = "day", columns: Sequence[str] | None = None) -> DataFrame:
    """Per day and feature: count, mean, squared distances from it, range and a rank sketch, from one aggregate by day."""
    columns = [c for c in numeric_columns(df) if c != day] if columns is None else list(columns)
    aggs = []
    for i, c in enumerate(columns):
        v = present(c)
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mean{i}"), (F.var_pop(v) * F.count(v)).alias(f"m2{i}"), F.min(v).alias(f"low{i}"),
                 F.max(v).alias(f"high{i}"), F.kll_sketch_agg_double(v, SKETCH_K).alias(f"sketch{i}")]
    parts = ["n", "mean", "m2", "low", "high", "sketch"]
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{p}{i}").alias(p) for p in parts]) for i, c in enumerate(columns)])
    return df.groupBy(day).agg(*aggs).select(F.col(day).alias("day"), F.inline(rows)).where("n > 0")


def merged_statistics(state: DataFrame) -> DataFrame:
    """One row per feature from the rows of any days: n, mean, std, min, max and the merged sketch."""
    totals = state.groupBy("feature").agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("centre"))
    # Both sides hold one row per day and feature at most.
    apart = F.col("m2") + F.col("n") * (F.col("mean") - F.col("centre")) * (F.col("mean") - F.col("centre"))
    merged = state.join(totals, "feature").groupBy("feature").agg(
        F.max("total").alias("n"), F.max("centre").alias("mean"), F.sum(apart).alias("m2"), F.min("low").alias("min"), F.max("high").alias("max"),
        F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select("feature", "n", "mean", F.sqrt(safe_ratio(F.col("m2"), F.col("n") - 1)).alias("std"), "min", "max", "sketch")


def rolled_up_stats(state: DataFrame, rows: DataFrame, exact_limit: int = EXACT_LIMIT) -> DataFrame:
    """Reference statistics (mean, std, min, max, exact quartiles) of days whose state is stored.

    Moments come from the state alone. The merged sketches enclose each quartile's rank, so a pass over ``rows``, the days'
    data, counts what lies below and another one looks at the enclosed values alone. A rank that a sketch failed to enclose, or
    enclosed with too many values, is searched for from the start, so the result is exact always.
    """
    spark = state.sparkSession
    merged = merged_statistics(state)
    # One row per feature.
    marks = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(p + side * MARGIN)) for p in QUARTILES for side in (-1, 1)])
    known = {r["feature"]: r for r in merged.withColumn("marks", marks).drop("sketch").collect()}
    sizes = {c: r["n"] for c, r in known.items()}
    brackets: dict[tuple[str, float, float], list[int]] = {}
    for c, r in known.items():
        for i, p in enumerate(QUARTILES):
            for rank in rank_neighbours(p, r["n"]):
                ranks = brackets.setdefault((c, r["marks"][2 * i], r["marks"][2 * i + 1]), [])
                if rank not in ranks:
                    ranks.append(rank)
    found, missed = values_in_brackets(rows, brackets, sizes, exact_limit)
    if missed:
        found.update(values_at_ranks(rows, missed, sizes, exact_limit))
    quartiles = quantiles_at(found, sizes, QUARTILES)
    out = [(c, r["mean"], r["std"], r["min"], r["max"], *quartiles[c]) for c, r in known.items()]
    return spark.createDataFrame(out, "feature string, mean double, std double, min double, max double, q25 double, median double, q75 double")


# -- distinct entities -------------------------------------------------------------------------------


def access_state(spark: SparkSession, base: str) -> DailyState:
    return DailyState(spark, base, ACCESS_STATE_SCHEMA)


def day_accesses(log: DataFrame, ts: str = "accessed_at", number: str = "entity_number") -> DataFrame:
    """Per day, table and stretch of 32,768 numbers: accesses, and a bitmap of the entities seen.

    ``number`` is a whole number per entity; dense numbers, as ``with_entity_id`` gives, make small states.
    """
    n = F.col(number).cast("long")
    return log.where(n.isNotNull()).groupBy(F.to_date(ts).alias("day"), "table_name", F.bitmap_bucket_number(n).alias("bucket")).agg(
        F.count(F.lit(1)).alias("accesses"), F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bits"))


def access_rollup(state: DailyState, last: date, days: int) -> DataFrame:
    """Accesses and distinct entities per table in the ``days`` days up to ``last``, exact, from the state alone."""
    rows = state.read(last - timedelta(days=days - 1), last)
    united = rows.groupBy("table_name", "bucket").agg(F.sum("accesses").alias("accesses"), F.bitmap_or_agg("bits").alias("bits"))
    return united.groupBy("table_name").agg(F.sum("accesses").alias("access_count"), F.sum(F.bitmap_count("bits")).alias("unique_entities"))
