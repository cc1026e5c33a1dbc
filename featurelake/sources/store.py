"""Registry, offline data sets and serving tables behind one object."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from featurelake.operators.validate import consistency_check
from featurelake.sources.offline import OfflineStore
from featurelake.sources.registry import FeatureRegistry
from featurelake.sources.serving import ServingStore
from featurelake.sources.status import store_status


class FeatureStore:
    """Resolves feature groups to columns and passes the work on to the stores."""

    def __init__(self, spark: SparkSession, base: str, registry: FeatureRegistry | None = None):
        self.registry = registry or FeatureRegistry.default(spark)
        self.offline = OfflineStore(spark, f"{base.rstrip('/')}/offline")
        self.serving = ServingStore(spark, f"{base.rstrip('/')}/serving")

    def ingest_training_data(self, df: DataFrame, dataset: str, entity_column: str, version: str | None = None) -> str:
        return self.offline.ingest(df, dataset, entity_column, version=version)

    def get_training_data(self, dataset: str, version: str | None = None, group: str | None = None) -> DataFrame:
        """Rows of a version; a known group narrows them to its source columns."""
        columns = self.registry.source_columns(group) if group else None
        return self.offline.get_dataset(dataset, version, columns)

    def get_features_for_training(self, dataset: str, group: str, target: str, version: str | None = None) -> DataFrame:
        return self.registry.training_pair(self.offline.get_dataset(dataset, version), group, target)

    def materialize_for_serving(self, df: DataFrame, table: str, entity_column: str, group: str | None = None) -> int:
        columns = self.registry.source_columns(group) if group else None
        if columns is None:
            return self.serving.materialize(df, table, entity_column)
        return self.serving.materialize_group(df, table, entity_column, columns)

    def get_serving_features(self, table: str, ids: DataFrame | Sequence[Any], group: str | None = None) -> DataFrame:
        columns = self.registry.source_columns(group) if group else None
        return self.serving.get_features(table, ids, columns)

    def get_feature_vector(self, table: str, entity_id: Any) -> dict[str, Any]:
        return self.serving.get_feature_vector(table, entity_id)

    def sync_offline_to_serving(self, dataset: str, table: str, entity_column: str, version: str | None = None) -> int:
        return self.serving.sync_from(self.offline, dataset, table, entity_column, version)

    def validate_consistency(self, dataset: str, table: str, entity_column: str,
                             sample_size: int | None = 100) -> DataFrame:
        return consistency_check(self.offline.get_dataset(dataset), self.serving.table(table), entity_column, sample_size)

    def status(self) -> DataFrame:
        return store_status(self.registry, self.offline, self.serving)
