"""Append logs as streams: counters, rolling windows, joins and drift checks.

The rolling-window operators of ``featurelake.operators.traffic`` run on a stream unchanged; this
module adds reading, watermarks, sinks and the operators that only make sense on a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from featurelake.functions.scalars import json_text, parse_json_body
from featurelake.operators.alerts import alerts_from_drift
from featurelake.operators.drift import DRIFT_THRESHOLD, drift_features, drift_summary, prediction_drift_of
from featurelake.session import scratch_path

# Fixed value: records older than this are rejected.
MAX_AGE_HOURS = 168


def as_stream_path(path: str) -> str:
    """Stream sources take folders or patterns; a pattern that matches one name admits a single file."""
    return path if path.endswith("/") else f"{path[:-1]}[{path[-1]}]"


def stream_log(spark: SparkSession, path: str, schema: StructType | str, ts: str, fmt: str = "parquet",
               delay: str = "10 minutes", files_per_batch: int | None = None) -> DataFrame:
    """Stream over an append-only log with a watermark on its event time.

    Zone-less event times are read in the session zone, because watermarks need instants.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.format(fmt).load(as_stream_path(path))
    return raw.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def start_append(sdf: DataFrame, sink: str, state: str, fmt: str = "parquet", **trigger) -> StreamingQuery:
    """Start an exactly-once file sink; ``trigger`` is passed on, by default all available data."""
    return (
        sdf.writeStream.outputMode("append").format(fmt).option("path", sink).option("checkpointLocation", state)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def drain_to_table(sdf: DataFrame, tag: str) -> DataFrame:
    """Run a stream over everything available into a Parquet sink; returns the sink as a table."""
    spark = sdf.sparkSession
    sink = scratch_path(spark, tag)
    start_append(sdf, sink, scratch_path(spark, f"{tag}-state")).awaitTermination()
    return spark.read.schema(sdf.schema).parquet(sink)


def drain_batches(sdf: DataFrame, handler: Callable[[DataFrame, int], None], tag: str, mode: str = "append") -> None:
    """Run a stream over everything available through a per-batch handler."""
    query = (
        sdf.writeStream.outputMode(mode).foreachBatch(handler)
        .option("checkpointLocation", scratch_path(sdf.sparkSession, f"{tag}-state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def running_counts(sdf: DataFrame, keys: Sequence[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """Counters per key since the start; state holds one row per key."""
    return sdf.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in (sums or {}).items()])


def drain_counters(counters: DataFrame, keys: Sequence[str], tag: str) -> DataFrame:
    """Changed counters of every batch go into a folder of their own, so a repeated batch replaces
    itself; the newest value per key is the current one."""
    spark = counters.sparkSession
    sink = scratch_path(spark, tag)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    drain_batches(counters, store, tag, "update")
    values = [c for c in counters.columns if c not in keys]
    schema = StructType([*counters.schema.fields, StructField("batch_id", LongType())])
    log = spark.read.schema(schema).parquet(sink)
    return log.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("r")).select(*keys, "r.*")


def join_feedback_streams(predictions: DataFrame, feedback: DataFrame, bound: str, key: str = "prediction_id",
                          prediction_ts: str = "ts", feedback_ts: str = "feedback_ts") -> DataFrame:
    """Feedback with the prediction made at most ``bound`` before it; late answers stay unmatched.

    Both sides need watermarks; the time bound lets Spark drop state and decide that a feedback
    row will find no partner any more.
    """
    p = predictions.select(F.col(key).alias("__key"), F.col(prediction_ts).alias("__made"), "prediction")
    matched = feedback.join(p, F.expr(
        f"`{key}` = __key AND __made <= `{feedback_ts}` AND __made >= `{feedback_ts}` - INTERVAL {bound}"), "left_outer")
    return matched.select(key, feedback_ts, "actual_outcome", "prediction",
                          (F.col("prediction") == F.col("actual_outcome")).alias("was_correct"))


def drift_batch(reference: DataFrame, inputs: Sequence[str], features_sink: str, alerts_sink: str,
                threshold: float = DRIFT_THRESHOLD) -> Callable[[DataFrame, int], None]:
    """Per-batch handler: drift of the batch's inputs and predictions against fixed reference
    statistics go to a drift table, and alert rows to an alert table.

    A reference is required: without one no data drift can be found. Every batch has a folder of
    its own, so a batch repeated after a failure replaces itself.
    """
    if reference is None:
        raise ValueError("a drift stream needs reference statistics")

    # One row per input, read once when the stream starts.
    known = [(r["feature"], r["mean"], r["std"]) for r in reference.select("feature", "mean", "std").collect()]

    def check(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        values = {c: F.col(c).cast("double") for c in inputs}
        # Everything the checks need, in one pass over the batch.
        row = batch.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == 0).alias("zeros"), F.count_if(F.col("prediction") == 1).alias("ones"),
                        *[F.avg(F.when(~F.isnan(v), v)).alias(f"mean{i}") for i, v in enumerate(values.values())]).first()
        if not row["n"]:
            return
        stats = spark.createDataFrame(known, "feature string, mean double, std double")
        current = spark.createDataFrame([(c, row[f"mean{i}"]) for i, c in enumerate(inputs)], "feature string, mean double")
        features = drift_features(stats, current)
        features.write.mode("overwrite").parquet(f"{features_sink}/batch_id={batch_id}")
        counts = spark.createDataFrame([(row["n"], row["zeros"] / row["n"], row["ones"] / row["n"])], "sample_size long, s0 double, s1 double")
        alerts = alerts_from_drift(drift_summary(features, threshold), prediction_drift_of(counts, threshold=threshold), F.current_timestamp(), features)
        alerts.write.mode("overwrite").parquet(f"{alerts_sink}/batch_id={batch_id}")

    return check


def drop_late(df: DataFrame, ts: str, hours: int = MAX_AGE_HOURS, now: Column | None = None) -> DataFrame:
    """Reject records older than the limit, measured against the wall clock or a given instant."""
    at = F.current_timestamp() if now is None else now
    return df.where(F.col(ts) >= at - F.make_dt_interval(hours=F.lit(hours)))


def search_logs(df: DataFrame, service: str, fields: Sequence[str], body: str = "body") -> DataFrame:
    """Lines of one service with the wanted JSON fields as columns; plain lines give nulls.

    Stateless, so it serves tables and streams alike.
    """
    parsed = F.when(parse_json_body(F.col(body)).isNotNull(), F.col(body))
    return df.where(F.col("service") == service).withColumns({f: json_text(parsed, f) for f in fields})
