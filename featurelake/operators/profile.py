"""Descriptive statistics of a whole frame in few passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelake.functions.ordering import EXACT_LIMIT, exact_quantiles, present
from featurelake.functions.scalars import ratio_or_zero
from featurelake.operators.prepare import numeric_columns


def dataset_profile(df: DataFrame, approximate_distinct: bool = False) -> DataFrame:
    """One row per column: type, nulls, and moments (numbers) or distinct count (others).

    Nulls and moments of all columns share one aggregate without a shuffle of rows. Exact distinct
    counts come from a second, narrow pass over (column, value) pairs, de-duplicated map-side.
    """
    numeric = set(numeric_columns(df))
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        value = present(c) if c in numeric else F.col(f"`{c}`")
        aggs.append(F.count_if(value.isNull()).alias(f"nulls{i}"))
        if c in numeric:
            aggs += [F.avg(value).alias(f"mean{i}"), F.stddev_samp(value).alias(f"std{i}"),
                     F.min(value).alias(f"min{i}"), F.max(value).alias(f"max{i}")]
        elif approximate_distinct:
            aggs.append(F.approx_count_distinct(value).alias(f"uniq{i}"))
    kinds = dict(df.dtypes)

    def entry(i: int, c: str):
        is_number = c in numeric

        def stat(name: str):
            return (F.round(F.col(f"{name}{i}"), 4) if is_number else F.lit(None).cast("double")).alias(name)

        uniq = F.col(f"uniq{i}") if approximate_distinct and not is_number else F.lit(None).cast("bigint")
        return F.struct(
            F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.col(f"nulls{i}").alias("null_count"),
            F.round(ratio_or_zero(F.col(f"nulls{i}") * 100.0, F.col("rows")), 2).alias("null_pct"),
            stat("mean"), stat("std"), stat("min"), stat("max"), uniq.alias("unique_count"))

    out = df.agg(*aggs).select(
        F.col("rows").alias("num_rows"), F.lit(len(df.columns)).alias("num_columns"),
        F.inline(F.array(*[entry(i, c) for i, c in enumerate(df.columns)])))
    others = [c for c in df.columns if c not in numeric]
    if approximate_distinct or not others:
        return out
    pairs = F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in others]))
    counts = df.select(pairs).where(F.col("value").isNotNull()).distinct().groupBy("column").agg(
        F.count(F.lit(1)).alias("found"))
    unique = F.when(~F.col("column").isin(list(numeric)), F.coalesce("found", F.lit(0)))
    return out.join(counts, "column", "left").withColumn("unique_count", unique).drop("found")


def column_moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, mean, std, min, max) per numeric column from one aggregate.

    NaN counts as missing, so a frame full of NaN has no mean rather than a NaN one.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "feature string, mean double, std double, min double, max double")
    aggs = []
    for i, c in enumerate(columns):
        value = present(c)
        aggs += [F.avg(value).alias(f"mean{i}"), F.stddev_samp(value).alias(f"std{i}"),
                 F.min(value).alias(f"min{i}"), F.max(value).alias(f"max{i}")]
    stats = ["mean", "std", "min", "max"]
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{s}{i}").alias(s) for s in stats])
        for i, c in enumerate(columns)])
    return df.agg(*aggs).select(F.inline(rows))


def reference_stats(df: DataFrame, columns: Sequence[str] | None = None,
                    exact_limit: int = EXACT_LIMIT) -> DataFrame:
    """Moments plus exact median and quartiles (linear interpolation) per numeric column."""
    columns = numeric_columns(df) if columns is None else list(columns)
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75], exact_limit)
    rows = [(c, *quartiles[c]) for c in columns]
    cuts = df.sparkSession.createDataFrame(rows, "feature string, q25 double, median double, q75 double")
    return column_moments(df, columns).join(F.broadcast(cuts), "feature")
