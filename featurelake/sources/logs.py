"""Prediction and feedback logs as JSON lines by day, and reference snapshots.

A log is a folder ``day=<date>/batch=<write>`` of JSON files, so the newest records are found from the names of days alone.
``compact_day`` joins the small files of a day: the new batch counts once a commit of the day names it with the batches it
replaces; readers leave the replaced ones out, whether or not they are still there.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelake.sources.commits import CommitConflict, CommitLog
from featurelake.sources.files import child_names, matching_paths, path_exists, read_or_empty, read_text, remove_path

# Fields of the prediction and feedback records.
PREDICTION_SCHEMA = (
    "type string, timestamp timestamp_ntz, input map<string,string>, "
    "output struct<prediction_id: string, prediction: int, label: string, probability_no_turning_point: double, "
    "probability_turning_point: double, confidence: double, model_version: string, loaded_from: string>, "
    "model_version string"
)
FEEDBACK_SCHEMA = (
    "type string, timestamp timestamp_ntz, prediction_id string, actual_outcome int, comment string, "
    "was_correct boolean"
)


def prediction_records(scored: DataFrame, inputs: list[str], ts: str = "timestamp") -> DataFrame:
    """Log records for scored rows: the model inputs, never just the id, travel with the score."""
    have = set(scored.columns)
    fields = ["prediction_id", "prediction", "label", "probability_no_turning_point", "probability_turning_point",
              "confidence", "model_version", "loaded_from"]
    kinds = {"prediction": "int", "probability_no_turning_point": "double", "probability_turning_point": "double",
             "confidence": "double"}
    output = F.struct(*[
        (F.col(f) if f in have else F.lit(None)).cast(kinds.get(f, "string")).alias(f) for f in fields])
    return scored.select(
        F.lit("prediction").alias("type"), F.col(ts).cast("timestamp_ntz").alias("timestamp"),
        F.create_map(*[x for c in inputs for x in (F.lit(c), F.col(c).cast("string"))]).alias("input"),
        output.alias("output"), output["model_version"].alias("model_version"))


def feedback_records(feedback: DataFrame, ts: str = "timestamp") -> DataFrame:
    comment = F.col("comment") if "comment" in feedback.columns else F.lit(None)
    return feedback.select(
        F.lit("feedback").alias("type"), F.col(ts).cast("timestamp_ntz").alias("timestamp"),
        F.col("prediction_id").cast("string").alias("prediction_id"),
        F.col("actual_outcome").cast("int").alias("actual_outcome"),
        comment.cast("string").alias("comment"), F.col("was_correct").cast("boolean").alias("was_correct"))


NO_DAY = "__HIVE_DEFAULT_PARTITION__"
COMPACTION_SCHEMA = "batch string, replaces array<string>"
JOINED = "joined-"


def append_log(records: DataFrame, path: str, ts: str = "timestamp") -> None:
    """Append records as one batch in the folders of their days.

    Rows are dealt by day so that a day gets few files; a day that holds most rows is split by adaptive execution.
    """
    batch = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    dated = records.withColumns({"day": F.to_date(ts), "batch": F.lit(batch)})
    dated.hint("rebalance", "day").write.mode("append").partitionBy("day", "batch").json(path)


def log_days(spark: SparkSession, path: str) -> list[str]:
    """Names of the days of a log, newest first; records without a time come last."""
    names = [name[4:] for name, _ in child_names(spark, path) if name.startswith("day=")]
    return sorted((n for n in names if n != NO_DAY), reverse=True) + [n for n in names if n == NO_DAY]


def _left_out(spark: SparkSession, path: str, day: str = "*") -> list[str]:
    """Batches of days, as day/batch, that do not count: those a compaction replaced, and joined ones that no commit names."""
    out, named = set(), set()
    for file in matching_paths(spark, f"{path}/day={day}/_compactions/*.json"):
        of, commit = file.rsplit("/day=", 1)[1].split("/")[0], json.loads(read_text(spark, file))
        named.add(f"{of}/{commit['batch']}")
        out.update(f"{of}/{b}" for b in commit["replaces"])
    joined = {p.rsplit("/day=", 1)[1].replace("/batch=", "/") for p in matching_paths(spark, f"{path}/day={day}/batch={JOINED}*")}
    return sorted(out | (joined - named))


def _counting(out: list[str]) -> Column:
    """Test on the partition columns alone, so it chooses folders before any file is read."""
    place = F.concat(F.coalesce(F.col("day").cast("string"), F.lit(NO_DAY)), F.lit("/"), F.col("batch"))
    return ~place.isin(out) if out else F.lit(True)


def read_log(spark: SparkSession, path: str, schema: str, days: list[str] | None = None) -> DataFrame:
    """Log of the given days, or whole; a missing log is empty and blank lines are skipped by the reader.

    Only the folders of the given days are listed and read.
    """
    names = log_days(spark, path) if days is None else days
    if not names:
        return read_or_empty(spark, path, schema, "json")
    reader = spark.read.schema(f"{schema}, day date, batch string").option("basePath", path)
    if days is None:
        return reader.json(path).where(_counting(_left_out(spark, path))).drop("day", "batch")
    out = [b for day in days for b in _left_out(spark, path, day)]
    return reader.json([f"{path}/day={day}" for day in days]).where(_counting(out)).drop("day", "batch")


def newest_days(spark: SparkSession, path: str, n: int) -> list[str]:
    """The newest days that hold ``n`` records; lines are counted without being parsed, ever more days at a time."""
    names, found, taken = log_days(spark, path), 0, 0
    while found < n and taken < len(names):
        more = names[taken:max(2 * taken, 1)]
        out = [b for day in more for b in _left_out(spark, path, day)]
        lines = spark.read.schema("value string, day date, batch string").option("basePath", path).text([f"{path}/day={day}" for day in more])
        counted = lines.where(_counting(out) & (F.trim("value") != "")).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
        # One row for each of these days.
        by_day = {NO_DAY if r["day"] is None else r["day"].isoformat(): r["n"] for r in counted.collect()}
        for name in more:
            taken += 1
            found += by_day.get(name, 0)
            if found >= n:
                break
    return names[:taken]


def last_records(spark: SparkSession, path: str, schema: str, n: int, tie: Column) -> DataFrame:
    """Last ``n`` records by time, read from the newest days alone."""
    if not log_days(spark, path):
        return read_or_empty(spark, path, schema, "json").orderBy(F.desc("timestamp"), tie.desc()).limit(n)
    return read_log(spark, path, schema, newest_days(spark, path, n)).orderBy(F.desc("timestamp"), tie.desc()).limit(n)


def recent_predictions(spark: SparkSession, path: str, n: int = 1000) -> DataFrame:
    pid = F.col("output.prediction_id")
    return last_records(spark, path, PREDICTION_SCHEMA, n, pid).withColumn("prediction_id", pid)


def recent_feedback(spark: SparkSession, path: str, n: int = 1000) -> DataFrame:
    return last_records(spark, path, FEEDBACK_SCHEMA, n, F.col("prediction_id"))


def compact_day(spark: SparkSession, path: str, day: str) -> int:
    """Join the batches of one day into one; returns how many were joined.

    Lines are copied as they are. Batches appended meanwhile stay beside the joined one. If another writer has compacted some of
    the same batches, this one's work is dropped. A failure before the commit changes nothing for readers.
    """
    folder = f"{path}/day={day}"
    commits = CommitLog(spark, f"{folder}/_compactions", COMPACTION_SCHEMA)
    seen = commits.last()
    out = set(_left_out(spark, path, day))
    batches = [name[6:] for name, _ in child_names(spark, folder) if name.startswith("batch=") and f"{day}/{name[6:]}" not in out]
    if len(batches) < 2:
        return 0
    joined = f"{JOINED}{uuid.uuid4().hex}"
    # Lines move to as few files as their size asks for; a shuffle by nothing but balance.
    spark.read.text([f"{folder}/batch={b}" for b in batches]).hint("rebalance").write.text(f"{folder}/batch={joined}")
    rivals: set[str] = set()

    def record(number: int) -> dict:
        if rivals & set(batches):
            raise CommitConflict(f"another writer has compacted batches of {day}")
        return {"batch": joined, "replaces": batches}

    try:
        commits.commit(record, seen, lambda other: rivals.update(other["replaces"]))
    except CommitConflict:
        remove_path(spark, f"{folder}/batch={joined}")
        return 0
    return len(batches)


def remove_replaced(spark: SparkSession, path: str, day: str) -> int:
    """Remove the replaced batches of a day once no reader uses them; returns how many went."""
    left = [place.split("/", 1)[1] for place in _left_out(spark, path, day)]
    gone = [b for b in left if path_exists(spark, f"{path}/day={day}/batch={b}")]
    for batch in gone:
        remove_path(spark, f"{path}/day={day}/batch={batch}")
    return len(gone)


def save_reference(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_reference(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
