"""Overview of registry, offline data sets and serving tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelake.sources.offline import OfflineStore
from featurelake.sources.registry import FeatureRegistry
from featurelake.sources.serving import ServingStore


def store_status(registry: FeatureRegistry, offline: OfflineStore, serving: ServingStore) -> DataFrame:
    """Rows (item, name, n): feature and group counts, then one row per data set and table."""
    def counted(df: DataFrame, item: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(item).alias("item"), F.lit(None).cast("string").alias("name"), "n")

    versions = offline.manifest().groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    datasets = offline.list_datasets().join(versions, "dataset", "left").select(
        F.lit("dataset").alias("item"), F.col("dataset").alias("name"), F.coalesce("n", F.lit(0)).alias("n"))
    tables = serving.catalog().select(
        F.lit("table").alias("item"), F.col("table_name").alias("name"), F.col("num_rows").alias("n"))
    groups = registry.members.select("group_name").distinct()
    return (counted(registry.features, "features").unionByName(counted(groups, "groups"))
            .unionByName(datasets).unionByName(tables))
