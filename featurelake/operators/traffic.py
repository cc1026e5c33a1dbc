"""Request, access and job roll-ups with their alert conditions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurelake.functions.histogram import LATENCY_BOUNDS, cumulative_counts, quantile_from_counts
from featurelake.functions.ordering import overlap_buckets, tail_rows, values_at_ranks
from featurelake.functions.scalars import literal, metric_name, safe_ratio

# Alert limits, staleness limits in seconds, late-data limit.
ERROR_RATIO_LIMIT = 0.05
P95_LIMIT_SECONDS = 1.0
MAX_AGE_SECONDS = {"training": 691_200, "monitoring": 28_800}
ACCESS_DAYS = 7


# -- requests ------------------------------------------------------------------------------------


def clean_requests(df: DataFrame) -> DataFrame:
    """Request rows with defaults applied: method upper case or UNKNOWN, endpoint, duration >= 0."""
    return df.withColumns({
        "method": F.upper(F.coalesce(F.nullif(F.col("method"), F.lit("")), F.lit("UNKNOWN"))),
        "endpoint": F.coalesce(F.nullif(F.col("endpoint"), F.lit("")), F.lit("unknown")),
        "duration": F.greatest(F.col("duration"), F.lit(0.0)),
    })


def requests_by_endpoint(requests: DataFrame) -> DataFrame:
    return clean_requests(requests).groupBy(F.concat_ws(" ", "method", "endpoint").alias("request")).agg(
        F.count(F.lit(1)).alias("n"))


def requests_by_status(requests: DataFrame) -> DataFrame:
    return requests.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def latency_summary(requests: DataFrame, ts: str = "ts", tie: str = "request_id",
                    samples: int | None = None) -> DataFrame:
    """Latency figures over all requests, or the last ``samples``, in milliseconds; no rows, no result.

    A percentile is the value at 0-based position floor(n * q) of the sorted durations, found by
    narrowing brackets, so no task ever holds the sorted log.
    """
    rows = clean_requests(requests).select(ts, tie, "duration")
    if samples is not None:
        rows = tail_rows(rows, samples, ts, tie)
    rows = rows.where(F.col("duration").isNotNull())
    n = rows.count()
    at = {q: min(n - 1, int(n * q)) for q in (0.95, 0.99)} if n else {}
    found = values_at_ranks(rows, {"duration": set(at.values())}, {"duration": n}) if n else {}
    stats = {"avg_ms": F.avg("duration"), "min_ms": F.min("duration"), "max_ms": F.max("duration"),
             **{f"p{int(q * 100)}_ms": F.lit(found.get(("duration", at.get(q)))) for q in (0.95, 0.99)}}
    return rows.agg(F.count(F.lit(1)).alias("samples"), *[F.round(v * 1000, 2).alias(name) for name, v in stats.items()]) \
        .where("samples > 0")


def requests_per_second(requests: DataFrame, ts: str = "ts") -> DataFrame:
    seconds = F.timestamp_diff("MICROSECOND", F.min(ts), F.max(ts)) / F.lit(1e6)
    return requests.agg(F.count(F.lit(1)).alias("total_requests"),
                        F.round(F.coalesce(safe_ratio(F.count(F.lit(1)), seconds), F.lit(0.0)), 4).alias("rps"))


def access_stats(log: DataFrame, as_of: datetime | None = None, days: int = ACCESS_DAYS,
                 table: str | None = None) -> DataFrame:
    """Accesses and distinct entities per table in the last days; ``as_of`` defaults to the newest row."""
    if as_of is None:
        as_of = log.agg(F.max("accessed_at")).first()[0]
    kind = log.schema["accessed_at"].dataType
    since = literal(as_of, kind) - F.make_dt_interval(days=F.lit(days))
    rows = log.where(F.col("accessed_at") >= since)
    rows = rows if table is None else rows.where(F.col("table_name") == table)
    return rows.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("access_count"), F.count_distinct("entity_id").alias("unique_entities"))


# -- rolling windows (batch and stream) ----------------------------------------------------------


def rolling(df: DataFrame, ts: str, length: str, slide: str, sums: Mapping[str, Column],
            keys: Sequence[str] = (), event_time: str | None = None) -> DataFrame:
    """Sums over sliding windows, pre-aggregated per slide.

    Each row is counted once into its slide; only these partial sums are spread over the windows
    that contain them. The same plan runs on a stream (append mode, watermark on ``ts``); a further
    stateful step needs ``event_time``, the name of a column that carries the watermark on.
    """
    partial = df.groupBy(F.window(ts, slide).alias("slot"), *keys).agg(*[c.alias(n) for n, c in sums.items()])
    spread = partial.groupBy(F.window(F.window_time("slot"), length, slide).alias("w"), *keys).agg(
        *[F.sum(n).alias(n) for n in sums])
    carried = [F.window_time("w").alias(event_time)] if event_time else []
    return spread.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                         *carried, *keys, *sums)


def request_rate(df: DataFrame, ts: str = "ts", length: str = "5 minutes", slide: str = "1 minute",
                 seconds: int = 300) -> DataFrame:
    counted = rolling(df, ts, length, slide, {"n": F.count(F.lit(1))})
    return counted.withColumn("rate", F.round(F.col("n") / seconds, 4))


def error_ratio(df: DataFrame, ts: str = "ts", length: str = "5 minutes", slide: str = "1 minute",
                seconds: int = 300, floor: float | None = 1.0, limit: float = ERROR_RATIO_LIMIT) -> DataFrame:
    """Share of 5xx answers; with ``floor`` the denominator is at least so many requests per second."""
    counted = rolling(df, ts, length, slide, {
        "n": F.count(F.lit(1)), "errors": F.count_if(F.col("status").between(500, 599))})
    requests = F.col("n") / seconds
    ratio = (F.col("errors") / seconds) / (F.greatest(requests, F.lit(floor)) if floor else requests)
    return counted.withColumns({"error_ratio": F.round(ratio, 4), "alert": ratio > limit})


def latency_quantiles(df: DataFrame, ts: str = "ts", length: str = "5 minutes", slide: str = "1 minute",
                      quantiles: Mapping[str, float] | None = None, limit: float = P95_LIMIT_SECONDS,
                      bounds: Sequence[float] = LATENCY_BOUNDS) -> DataFrame:
    """p95 and p99 read from bucket counts per window; alert when p95 exceeds its limit."""
    quantiles = {"p95": 0.95, "p99": 0.99} if quantiles is None else quantiles
    buckets = {f"le_{i}": c for i, c in enumerate(cumulative_counts(F.col("duration"), bounds))}
    counted = rolling(df, ts, length, slide, buckets)
    values = {n: quantile_from_counts(q, bounds) for n, q in quantiles.items()}
    out = counted.select("window_start", "window_end", F.col(f"le_{len(bounds)}").alias("n"),
                         *[v.alias(n) for n, v in values.items()],
                         (values["p95"] > limit).alias("alert") if "p95" in values else F.lit(None).alias("alert"))
    return out


def class_share(df: DataFrame, ts: str = "ts", length: str = "1 hour", slide: str = "5 minutes",
                cls: int = 1, prediction: str = "prediction") -> DataFrame:
    counted = rolling(df, ts, length, slide, {
        "n": F.count(F.lit(1)), "hits": F.count_if(F.col(prediction) == cls)})
    return counted.withColumn("share", F.round(F.col("hits") / F.col("n"), 4))


def average_confidence(df: DataFrame, ts: str = "ts", length: str = "5 minutes", slide: str = "1 minute",
                       confidence: str = "confidence") -> DataFrame:
    counted = rolling(df, ts, length, slide, {
        "n": F.count(confidence), "total": F.sum(confidence)})
    return counted.select("window_start", "window_end", "n",
                          safe_ratio(F.col("total"), F.col("n")).alias("avg_confidence"))


def gauge_below(df: DataFrame, ts: str = "ts", gauge: str = "gauge", length: str = "5 minutes",
                slide: str = "1 minute", limit: float = 1.0) -> DataFrame:
    """Windows in which the mean of a 0/1 health gauge is below the limit."""
    counted = rolling(df, ts, length, slide, {
        "n": F.count(gauge), "total": F.sum(F.col(gauge).cast("bigint"))})
    mean = safe_ratio(F.col("total"), F.col("n"))
    return counted.select("window_start", "window_end", "n", F.round(mean, 4).alias("avg_gauge"),
                          F.coalesce(mean < limit, F.lit(False)).alias("alert"))


def sustained(evaluations: DataFrame, ts: str, condition: str, hold_steps: int, step_seconds: int = 60,
              keys: Sequence[str] = (), width: int = 10_080) -> DataFrame:
    """Evaluations at which a condition has held without a break for ``hold_steps`` steps.

    One row per evaluation step; a step without a row breaks the run. Each time bucket carries
    the steps before it that a frame can reach, so a long series is spread over many tasks.
    """
    epoch = F.lit("1970-01-01").cast(evaluations.schema[ts].dataType)
    step = F.floor(F.timestamp_diff("SECOND", epoch, F.col(ts)) / F.lit(step_seconds))
    placed = overlap_buckets(evaluations.withColumn("__step", step), F.col("__step"), max(width, hold_steps), hold_steps)
    frame = Window.partitionBy(*keys, "bucket").orderBy("__step").rangeBetween(-hold_steps, 0)
    held = F.count_if(F.col(condition)).over(frame) == hold_steps + 1
    return placed.withColumn("firing", held).where(~F.col("is_copy")).drop("__step", "bucket", "is_copy")


# -- jobs ----------------------------------------------------------------------------------------


def job_run_records(runs: DataFrame, prefix: str, extras: Mapping[str, Column] | None = None) -> DataFrame:
    """Run records: duration floored at 0, success as 0/1, exit code, and further named metrics."""
    metrics = F.create_map(*[
        x for name, value in (extras or {}).items() for x in (metric_name(F.lit(name), prefix), value.cast("double"))
    ]) if extras else F.create_map().cast("map<string,double>")
    return runs.select(
        "job", F.col("ts").alias("last_run"), F.greatest(F.col("duration"), F.lit(0.0)).alias("last_duration"),
        F.col("success").cast("int").alias("last_success"), F.col("exit_code").cast("int").alias("last_exit_code"),
        metrics.alias("metrics"))


def stale_jobs(runs: DataFrame, expected: DataFrame, as_of: datetime, ts: str = "last_run") -> DataFrame:
    """Expected jobs (job, max_age_seconds) that never ran or whose last run is too old."""
    last = runs.groupBy("job").agg(F.max(ts).alias("last_run"))
    now = literal(as_of, runs.schema[ts].dataType)
    age = F.timestamp_diff("SECOND", F.col("last_run"), now)
    return expected.join(last, "job", "left").select(
        "job", "last_run", age.alias("age_seconds"),
        (F.col("last_run").isNull() | (age > F.col("max_age_seconds"))).alias("stale"))


def failed_jobs(runs: DataFrame, ts: str = "last_run", tie: str = "run_id") -> DataFrame:
    """Status and duration of each job's last run; ``failed`` when it was no success."""
    last = runs.groupBy("job").agg(F.max_by(
        F.struct("last_success", "last_duration"), F.struct(ts, tie)).alias("r"))
    return last.select("job", "r.last_success", "r.last_duration",
                       (F.col("r.last_success") < 1).alias("failed"))


def metrics_overview(requests: DataFrame, predictions: DataFrame) -> dict[str, DataFrame]:
    """The usage roll-ups side by side, each still lazy."""
    from featurelake.operators.predictions import prediction_distribution

    return {
        "requests_by_endpoint": requests_by_endpoint(requests),
        "requests_by_status": requests_by_status(requests),
        "rps": requests_per_second(requests),
        "latency": latency_summary(requests),
        "predictions": prediction_distribution(predictions),
    }
