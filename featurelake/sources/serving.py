"""Latest-value serving tables, their catalog and the access log."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelake.session import cut_lineage
from featurelake.sources.commits import CommitLog
from featurelake.sources.files import read_or_empty, remove_path
from featurelake.sources.offline import OfflineStore

MATERIALIZED_AT = "_materialized_at"
CATALOG_SCHEMA = (
    "table_name string, entity_column string, feature_columns array<string>, path string, num_rows long, "
    "created_at timestamp, updated_at timestamp, dropped boolean"
)
ACCESS_SCHEMA = "table_name string, entity_id string, accessed_at timestamp"


class ServingStore:
    """Each materialisation writes a fresh folder and then switches the catalog to it.

    Readers of the old folder are never cut off in the middle of a scan. Files are range-sorted by
    entity, so a lookup skips all row groups whose entity range excludes the wanted ids.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")
        self.commits = CommitLog(spark, f"{self.base}/_commits", CATALOG_SCHEMA)
        self._access_path = f"{self.base}/_access_log"

    # -- catalog ----------------------------------------------------------------------------

    def _catalog_log(self) -> DataFrame:
        return self.commits.read()

    def catalog(self) -> DataFrame:
        """Live tables; the creation time is that of the first materialisation since a drop."""
        log = self._catalog_log()
        last = log.groupBy("table_name").agg(
            F.max_by(F.struct("*"), F.col("seq")).alias("row"))
        return last.select("row.*").where(~F.col("dropped")).drop("dropped", "seq")

    def list_tables(self) -> DataFrame:
        return self.catalog().drop("path", "num_rows")

    def _entry(self, table: str):
        return self.catalog().where(F.col("table_name") == table).first()

    def table(self, table: str) -> DataFrame:
        entry = self._entry(table)
        if entry is None:
            raise ValueError(f"serving table {table!r} not found")
        return self.spark.read.parquet(entry["path"])

    def get_table_info(self, table: str) -> dict[str, Any] | None:
        """Catalog row plus the counted rows (answered from Parquet footers)."""
        entry = self._entry(table)
        if entry is None:
            return None
        info = entry.asDict()
        info["num_rows"] = self.spark.read.parquet(info.pop("path")).count()
        return info

    def delete_table(self, table: str) -> bool:
        """Drop the table; dropping an unknown one succeeds as well."""
        entry = self._entry(table)
        if entry is not None:
            now = datetime.now(timezone.utc)
            self._log_table(table, entry["entity_column"], entry["feature_columns"], entry["path"], 0,
                            entry["created_at"], now, True)
            remove_path(self.spark, f"{self.base}/{table}")
        return True

    def _log_table(self, table: str, entity_column: str, features: Sequence[str], path: str, rows: int, created: datetime,
                   updated: datetime, dropped: bool) -> None:
        """Commit the switch; the table's creation time is taken over from whatever was committed last."""
        seen = self.commits.last()
        record = {"table_name": table, "entity_column": entity_column, "feature_columns": list(features), "path": path, "num_rows": rows,
                  "created_at": created.isoformat(), "updated_at": updated.isoformat(), "dropped": dropped}

        def check(other: dict[str, Any]) -> None:
            if other["table_name"] == table and not dropped:
                record["created_at"] = updated.isoformat() if other["dropped"] else other["created_at"]

        self.commits.commit(lambda number: record, seen, check)

    # -- data -------------------------------------------------------------------------------

    def materialize(self, df: DataFrame, table: str, entity_column: str,
                    features: Sequence[str] | None = None) -> int:
        """Replace the table by entity plus chosen features, stamped; returns the row count."""
        if features is None:
            features = [c for c in df.columns if c != entity_column]
        # A hash of the features splits an entity of very many rows; maps cannot be hashed.
        hashed = [c for c in features if "map<" not in df.schema[c].dataType.simpleString()]
        spread = [F.xxhash64(*hashed)] if hashed else []
        now = datetime.now(timezone.utc)
        path = f"{self.base}/{table}/at={now.strftime('%Y%m%d%H%M%S%f')}"
        (
            df.select(entity_column, *features)
            .withColumn(MATERIALIZED_AT, F.lit(now))
            .repartitionByRange(entity_column, *spread).sortWithinPartitions(entity_column)
            .write.mode("errorifexists").parquet(path)
        )
        rows = self.spark.read.parquet(path).count()
        previous = self._entry(table)
        created = previous["created_at"] if previous else now
        self._log_table(table, entity_column, list(features), path, rows, created, now, False)
        return rows

    def drop_old_generations(self, table: str) -> int:
        """Remove replaced folders once no reader uses them; returns how many went."""
        current = self._entry(table)["path"]
        old = [r["path"] for r in self._catalog_log().where(
            (F.col("table_name") == table) & (F.col("path") != current)).select("path").distinct().collect()]
        for path in old:
            remove_path(self.spark, path)
        return len(old)

    def materialize_group(self, df: DataFrame, table: str, entity_column: str,
                          group_columns: Sequence[str]) -> int:
        """Materialise only those group columns the frame has."""
        return self.materialize(df, table, entity_column, [c for c in group_columns if c in df.columns])

    def sync_from(self, offline: OfflineStore, dataset: str, table: str, entity_column: str,
                  version: str | None = None) -> int:
        return self.materialize(offline.get_dataset(dataset, version), table, entity_column)

    # -- lookup -----------------------------------------------------------------------------

    def get_features(self, table: str, ids: DataFrame | Sequence[Any], columns: Sequence[str] | None = None,
                     log_access: bool = True) -> DataFrame:
        """Rows whose entity is among the ids, entity first; absent ids yield no row.

        A list becomes a pushed-down IN. A frame of ids (first column) becomes a semi join, so
        repeated ids duplicate nothing; the stored ids have a known size to plan the join by.
        """
        entry = self._entry(table)
        if entry is None:
            raise ValueError(f"serving table {table!r} not found")
        entity = entry["entity_column"]
        rows = self.spark.read.parquet(entry["path"])
        if isinstance(ids, DataFrame):
            wanted = ids.select(F.col(ids.columns[0]).alias(entity))
            found = rows.join(cut_lineage(wanted.distinct()), entity, "left_semi")
        else:
            kind = rows.schema[entity].dataType
            wanted = self.spark.createDataFrame([(i,) for i in ids], f"`{entity}` {kind.simpleString()}")
            found = rows.where(F.col(entity).isin(list(ids)))
        if log_access:
            self.log_access(table, wanted)
        return found.select(entity, *columns) if columns else found

    def get_feature_vector(self, table: str, entity_id: Any, columns: Sequence[str] | None = None) -> dict[str, Any]:
        """First row of one entity as a mapping; empty when absent."""
        rows = self.get_features(table, [entity_id], columns)
        row = rows.orderBy(*rows.columns).limit(1).first()
        return row.asDict() if row else {}

    def log_access(self, table: str, ids: DataFrame) -> None:
        """One row per requested id, found or not."""
        access_rows(table, ids).write.mode("append").parquet(self._access_path)

    def access_log(self) -> DataFrame:
        return read_or_empty(self.spark, self._access_path, ACCESS_SCHEMA)


def access_rows(table: str, ids: DataFrame) -> DataFrame:
    return ids.select(
        F.lit(table).alias("table_name"), F.col(ids.columns[0]).cast("string").alias("entity_id"),
        F.current_timestamp().alias("accessed_at"))
