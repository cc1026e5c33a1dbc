"""Feature definitions and groups as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelake.functions.scalars import canonical_tag, normalize_tag

FEATURE_SCHEMA = (
    "name string, dtype string, description string, source string, transformation string, version string, "
    "tags array<string>"
)
# One row per member instead of an array per group: a group may be of any size.
MEMBER_SCHEMA = "group_name string, entity string, position int, feature string"

# The default features (name, type, source column, tags) and groups.
DEFAULT_FEATURES = [
    ("inde", "numeric", "INDE", ["index", "development"]),
    ("iaa", "numeric", "IAA", ["index", "self_assessment"]),
    ("ieg", "numeric", "IEG", ["index", "engagement"]),
    ("ips", "numeric", "IPS", ["index", "psychosocial"]),
    ("ida", "numeric", "IDA", ["index", "academic"]),
    ("ipp", "numeric", "IPP", ["index", "participation"]),
    ("ipv", "numeric", "IPV", ["index", "turning_point", "target_related"]),
    ("ian", "numeric", "IAN", ["index", "level"]),
    ("idade_aluno", "numeric", "IDADE_ALUNO", ["demographic"]),
    ("anos_pm", "numeric", "ANOS_PM", ["history", "engagement"]),
    ("instituicao_ensino", "categorical", "INSTITUICAO_ENSINO_ALUNO", ["demographic", "school"]),
    ("fase", "categorical", "FASE", ["program", "level"]),
    ("pedra", "categorical", "PEDRA", ["classification", "performance"]),
    ("bolsista", "categorical", "BOLSISTA", ["demographic", "scholarship"]),
]
DEFAULT_GROUPS = {
    "indices_avaliacao": ["inde", "iaa", "ieg", "ips", "ida", "ipp", "ipv", "ian"],
    "demografico": ["idade_aluno", "anos_pm", "instituicao_ensino", "bolsista"],
    "ponto_virada_features": ["inde", "iaa", "ieg", "ips", "ida", "ipp", "ipv", "ian", "idade_aluno", "anos_pm",
                              "instituicao_ensino", "fase", "pedra", "bolsista"],
}
DEFAULT_ENTITY = "aluno"
TRANSFORMATIONS = {"numeric": "standard_scaling", "categorical": "label_encoding"}


class FeatureRegistry:
    """Registry over two frames; every change returns a new registry."""

    def __init__(self, features: DataFrame, members: DataFrame):
        self.features = features
        self.members = members

    @classmethod
    def default(cls, spark: SparkSession) -> FeatureRegistry:
        features = [(n, t, None, s, TRANSFORMATIONS[t], "1.0.0", tags) for n, t, s, tags in DEFAULT_FEATURES]
        members = [(g, DEFAULT_ENTITY, i, f) for g, names in DEFAULT_GROUPS.items() for i, f in enumerate(names)]
        return cls(spark.createDataFrame(features, FEATURE_SCHEMA), spark.createDataFrame(members, MEMBER_SCHEMA))

    def save(self, path: str) -> None:
        """Write both tables below a fresh folder."""
        self.features.write.mode("errorifexists").parquet(f"{path}/features")
        self.members.write.mode("errorifexists").parquet(f"{path}/members")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureRegistry:
        return cls(spark.read.schema(FEATURE_SCHEMA).parquet(f"{path}/features"),
                   spark.read.schema(MEMBER_SCHEMA).parquet(f"{path}/members"))

    def register_features(self, features: DataFrame) -> FeatureRegistry:
        """Upsert by name: rows of the new frame win."""
        kept = self.features.join(features.select("name").distinct(), "name", "left_anti")
        return FeatureRegistry(kept.unionByName(features, allowMissingColumns=True), self.members)

    def register_group(self, members: DataFrame) -> FeatureRegistry:
        """Upsert whole groups by name."""
        kept = self.members.join(members.select("group_name").distinct(), "group_name", "left_anti")
        return FeatureRegistry(self.features, kept.unionByName(members, allowMissingColumns=True))

    def list_features(self) -> DataFrame:
        return self.features

    def list_groups(self) -> DataFrame:
        """Member count and entity per group."""
        return self.members.groupBy("group_name").agg(
            F.min("entity").alias("entity"), F.count(F.lit(1)).alias("members"))

    def group_features(self) -> DataFrame:
        """Definition of every member of every group, members without a definition dropped."""
        return self.members.join(
            self.features.withColumnRenamed("name", "feature"), "feature", "inner")

    def features_by_group(self, group: str) -> DataFrame:
        """Members of one group in group order."""
        return self.group_features().where(F.col("group_name") == group).orderBy("position")

    def features_by_tag(self, tag: str) -> DataFrame:
        """Features carrying the tag, ignoring accents, case and aliases; an empty tag finds none."""
        wanted = canonical_tag(F.lit(tag))
        return self.features.where(
            (normalize_tag(F.lit(tag)) != "")
            & F.exists("tags", lambda t: canonical_tag(t) == wanted))

    def source_columns(self, group: str) -> list[str] | None:
        """Source columns of a group in order; None for an unknown group.

        The result names columns of one table, so it is as small as a schema.
        """
        if self.members.where(F.col("group_name") == group).isEmpty():
            return None
        return [r["source"] for r in self.features_by_group(group).select("position", "source").collect()]

    def project(self, df: DataFrame, group: str, extra: Sequence[str] = ()) -> DataFrame:
        """Group's source columns; an unknown group keeps all columns."""
        columns = self.source_columns(group)
        return df if columns is None else df.select(*extra, *columns)

    def training_pair(self, df: DataFrame, group: str, target: str) -> DataFrame:
        columns = self.source_columns(group)
        if columns is None:
            raise ValueError(f"group {group!r} not found")
        return df.select(*columns, target)
