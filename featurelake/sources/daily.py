"""State by day: small mergeable rows that stand for a day's data, so that days are added without reading old ones."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelake.sources.commits import CommitLog
from featurelake.sources.files import path_exists, remove_path


class DailyState:
    """Rows of one schema by day. A write counts once it is committed; the last write of a day replaces earlier ones.

    A write is one folder, however many days it holds, so that small states do not become many small files.
    """

    def __init__(self, spark: SparkSession, base: str, schema: str):
        self.spark, self.base, self.schema = spark, base.rstrip("/"), f"{schema}, day date"
        self.commits = CommitLog(spark, f"{self.base}/_commits", "write string, days array<string>")

    def replace(self, rows: DataFrame) -> list[str]:
        """Write the state of all days that ``rows`` holds (column day); returns these days."""
        seen, write = self.commits.last(), uuid.uuid4().hex
        path = f"{self.base}/write={write}"
        rows.where(F.col("day").isNotNull()).write.mode("errorifexists").parquet(path)
        # One row a day.
        days = sorted(r[0].isoformat() for r in self.spark.read.schema(self.schema).parquet(path).select("day").distinct().collect())
        if days:
            self.commits.commit(lambda number: {"write": write, "days": days}, seen)
        return days

    def writes(self) -> tuple[dict[str, str], dict[str, list[str]]]:
        """The write that counts of every day, and the days of every write."""
        current: dict[str, str] = {}
        held: dict[str, list[str]] = {}
        for r in self.commits.read().orderBy("seq").toLocalIterator():
            current.update(dict.fromkeys(r["days"], r["write"]))
            held[r["write"]] = r["days"]
        return current, held

    def read(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """State of the days from first to last; only writes that hold one of them are listed."""
        current, held = self.writes()
        low, high = first.isoformat() if first else "", last.isoformat() if last else "~"
        wanted = sorted({w for d, w in current.items() if low <= d <= high})
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, write string").option("basePath", self.base).parquet(*[f"{self.base}/write={w}" for w in wanted])
        replaced = [f"{w}/{d}" for w in wanted for d in held[w] if current[d] != w]
        if replaced:
            rows = rows.where(~F.concat("write", F.lit("/"), F.col("day").cast("string")).isin(replaced))
        rows = rows.where(F.col("day") >= F.lit(first)) if first else rows
        return (rows.where(F.col("day") <= F.lit(last)) if last else rows).drop("write")

    def clean_up(self) -> int:
        """Remove the writes of which no day counts any more; returns how many went."""
        current, held = self.writes()
        dead = sorted(set(held) - set(current.values()))
        gone = [w for w in dead if path_exists(self.spark, f"{self.base}/write={w}")]
        for write in gone:
            remove_path(self.spark, f"{self.base}/write={write}")
        return len(gone)


def by_day(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("day", F.to_date(ts))
