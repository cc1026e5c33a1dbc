"""Versioned, immutable Parquet data sets with a manifest table."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta, timezone
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelake.sources.commits import CommitConflict, CommitLog
from featurelake.sources.files import child_names, remove_path

MANIFEST_SCHEMA = (
    "dataset string, version string, path string, entity_column string, timestamp_column string, "
    "num_rows long, num_columns int, columns array<string>, created_at timestamp, deleted boolean"
)


def filter_condition(df: DataFrame, filters: Mapping[str, Any] | None) -> Column:
    """AND of IN (list) and equality (scalar) tests; names the frame lacks are ignored."""
    tests = [
        F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == F.lit(value)
        for name, value in (filters or {}).items() if name in df.columns
    ]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


class OfflineStore:
    """``base/dataset=<name>/version=<version>/<write>`` folders, and a log of commits that says which of them count.

    Ingests and deletions are one commit each, numbered without gaps. Data that no commit names is invisible; ``clean_up``
    removes it. Of two writers of one version the first to commit wins, the other one is told and leaves no data.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")
        self.commits = CommitLog(spark, f"{self.base}/_commits", MANIFEST_SCHEMA)

    # -- manifest ---------------------------------------------------------------------------

    def _log(self) -> DataFrame:
        return self.commits.read()

    def manifest(self) -> DataFrame:
        """Live versions: the last commit per (dataset, version) that is no deletion."""
        last = self._log().groupBy("dataset", "version").agg(
            F.max_by(F.struct("*"), F.col("seq")).alias("row"))
        return last.select("row.*").where(~F.col("deleted")).drop("deleted")

    def list_datasets(self) -> DataFrame:
        """Every data set ever ingested, also one whose versions were all deleted."""
        return self._log().select("dataset").distinct()

    def list_versions(self, dataset: str) -> DataFrame:
        return self.manifest().where(F.col("dataset") == dataset)

    def get_dataset_info(self, dataset: str) -> dict[str, Any] | None:
        """Entity and timestamp columns, first ingest time and version count; None if unknown."""
        row = self._log().where((F.col("dataset") == dataset) & ~F.col("deleted")).agg(
            F.min_by("entity_column", "seq").alias("entity_column"),
            F.min_by("timestamp_column", "seq").alias("timestamp_column"),
            F.min("created_at").alias("created_at"), F.count(F.lit(1)).alias("n")).first()
        if not row["n"]:
            return None
        info = row.asDict()
        info["n"] = self.list_versions(dataset).count()
        return {"versions": info.pop("n"), **info}

    def latest_versions(self) -> DataFrame:
        """Last ingested version per data set; the order of ingest counts, not the name."""
        return self.manifest().groupBy("dataset").agg(
            F.max_by("version", "seq").alias("version"), F.max_by("path", "seq").alias("path"),
            F.max_by("num_rows", "seq").alias("num_rows"))

    def _entry(self, dataset: str, version: str | None):
        rows = self.list_versions(dataset)
        if version is not None:
            rows = rows.where(F.col("version") == version)
        entry = rows.orderBy(F.desc("seq")).limit(1).first()
        if entry is None:
            known = not self._log().where(F.col("dataset") == dataset).isEmpty()
            raise ValueError(f"version {version!r} of data set {dataset!r} not found" if known
                             else f"data set {dataset!r} not found")
        return entry

    # -- data -------------------------------------------------------------------------------

    def ingest(self, df: DataFrame, dataset: str, entity_column: str, timestamp_column: str | None = None,
               version: str | None = None) -> str:
        """Write one immutable version and commit it; the row count comes from the Parquet footers."""
        now = datetime.now(timezone.utc)
        version = version or now.strftime("%Y%m%d_%H%M%S")
        if entity_column not in df.columns:
            raise ValueError(f"entity column {entity_column!r} is not in the frame")
        seen = self.commits.last()
        if not self.list_versions(dataset).where(F.col("version") == version).isEmpty():
            raise ValueError(f"version {version!r} of data set {dataset!r} already exists")
        path = f"{self.base}/dataset={dataset}/version={version}/{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(path)
        rows = self.spark.read.parquet(path).count()
        record = {"dataset": dataset, "version": version, "path": path, "entity_column": entity_column, "timestamp_column": timestamp_column,
                  "num_rows": rows, "num_columns": len(df.columns), "columns": df.columns, "created_at": now.isoformat(), "deleted": False}
        taken = False

        def check(other: dict[str, Any]) -> None:
            nonlocal taken
            if (other["dataset"], other["version"]) == (dataset, version):
                taken = not other["deleted"]

        def mine(number: int) -> dict[str, Any]:
            if taken:
                raise CommitConflict(f"version {version!r} of data set {dataset!r} already exists: another writer committed it first")
            return record

        try:
            self.commits.commit(mine, seen, check)
        except CommitConflict:
            remove_path(self.spark, path)
            raise
        return path

    def get_dataset(self, dataset: str, version: str | None = None, columns: Sequence[str] | None = None,
                    filters: Mapping[str, Any] | None = None) -> DataFrame:
        """Rows of one version. Filters run before the projection and reach the Parquet scan."""
        df = self.spark.read.parquet(self._entry(dataset, version)["path"])
        df = df.where(filter_condition(df, filters)) if filters else df
        return df.select(*columns) if columns is not None else df

    def get_training_pair(self, dataset: str, features: Sequence[str], target: str,
                          version: str | None = None) -> DataFrame:
        """Features and target side by side in one frame."""
        return self.get_dataset(dataset, version, columns=[*features, target])

    def delete_version(self, dataset: str, version: str) -> bool:
        """Commit the deletion, then remove the data; a failure in between leaves only data that ``clean_up`` finds."""
        seen = self.commits.last()
        entry = self.list_versions(dataset).where(F.col("version") == version).first()
        if entry is None:
            return False
        fields = {**entry.asDict(), "created_at": entry["created_at"].isoformat(), "deleted": True}
        fields.pop("seq")
        self.commits.commit(lambda number: fields, seen)
        remove_path(self.spark, entry["path"])
        return True

    def clean_up(self, older_than: timedelta = timedelta(days=1)) -> int:
        """Remove folders that no live version names and that are old enough not to be a write under way; returns how many."""
        before = (datetime.now(timezone.utc) - older_than).timestamp() * 1000
        # One row for each live version, as in every manifest; data is not read.
        live = {r["path"].rsplit("/", 1)[1] for r in self.manifest().select("path").toLocalIterator()}
        removed = 0
        for dataset, _ in child_names(self.spark, self.base):
            for version, _ in child_names(self.spark, f"{self.base}/{dataset}") if dataset.startswith("dataset=") else []:
                for name, changed in child_names(self.spark, f"{self.base}/{dataset}/{version}"):
                    if name not in live and changed <= before:
                        remove_path(self.spark, f"{self.base}/{dataset}/{version}/{name}")
                        removed += 1
        return removed
