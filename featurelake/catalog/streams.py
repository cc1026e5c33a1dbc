"""Streaming queries: each runs over everything available and returns what its sink holds.

A window leaves the stream once the watermark (newest event minus the delay) has passed its end, so
the oracles leave out the windows still open at the end of the log.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from featurelake.catalog.bindings import PREDICTIONS, REQUESTS, Catalog, predictions, predictions_of, requests_of, table
from featurelake.catalog.monitoring import minute_windows
from featurelake.operators import traffic
from featurelake.operators.profile import column_moments
from featurelake.session import scratch_path
from featurelake.streaming import alerting, streams

catalog = Catalog()

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
DELAY = "10 minutes"
_CLOSED = "window_end <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


def _events(spark, sf):
    return streams.stream_log(spark, f"{sf}/events.parquet", EVENT_SCHEMA, "ts", delay=DELAY)


def _zoneless(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _windows(df):
    return _zoneless(df, "window_start", "window_end")


@catalog.add("stream_ingest", f"WITH p AS ({PREDICTIONS}) SELECT prediction_id, ts, prediction, label FROM p")
def _(spark, sf):
    log = predictions_of(_events(spark, sf)).select("prediction_id", "ts", "prediction", "label")
    return _zoneless(streams.drain_to_table(log, "ingest"), "ts")


@catalog.add("stream_counters", f"""
WITH q AS ({REQUESTS})
SELECT coalesce(upper(method), 'UNKNOWN') AS method, endpoint, status, count(*) AS n,
       count(*) FILTER (WHERE status >= 500) AS errors FROM q GROUP BY 1, 2, 3""")
def _(spark, sf):
    keys = ["method", "endpoint", "status"]
    log = traffic.clean_requests(requests_of(_events(spark, sf)))
    counters = streams.running_counts(log, keys, {"errors": F.count_if(F.col("status") >= 500)})
    return streams.drain_counters(counters, keys, "counters")


@catalog.add("stream_request_rate", f"""
WITH q AS ({REQUESTS}), w AS ({minute_windows("q", "count(*) AS n")})
SELECT window_start, window_end, n, round(n / 300.0::DOUBLE, 4) AS rate FROM w WHERE {_CLOSED}""")
def _(spark, sf):
    return _windows(streams.drain_to_table(traffic.request_rate(requests_of(_events(spark, sf))), "rate"))


@catalog.add("stream_error_ratio", f"""
WITH q AS ({REQUESTS}),
w AS ({minute_windows("q", "count(*) AS n, count(*) FILTER (WHERE status >= 500) AS errors")}),
r AS (SELECT *, (errors / 300.0::DOUBLE) / greatest(n / 300.0::DOUBLE, 1) AS ratio FROM w WHERE {_CLOSED})
SELECT window_start, window_end, n, errors, round(ratio, 4) AS error_ratio, ratio > 0.05 AS alert FROM r""")
def _(spark, sf):
    return _windows(streams.drain_to_table(traffic.error_ratio(requests_of(_events(spark, sf))), "errors"))


@catalog.add("stream_class1_share", f"""
WITH p AS ({PREDICTIONS}),
w AS ({minute_windows("p", "count(*) AS n, count(*) FILTER (WHERE prediction = 1) AS hits", 60, 5)})
SELECT window_start, window_end, n, hits, round(hits / n::DOUBLE, 4) AS share FROM w WHERE {_CLOSED}""")
def _(spark, sf):
    return _windows(streams.drain_to_table(traffic.class_share(predictions_of(_events(spark, sf))), "share"))


@catalog.add("stream_avg_confidence", f"""
WITH p AS ({PREDICTIONS}), w AS ({minute_windows("p", "count(*) AS n, avg(confidence) AS c")})
SELECT window_start, window_end, n, round(c, 10) AS avg_confidence FROM w WHERE {_CLOSED}""")
def _(spark, sf):
    averaged = traffic.average_confidence(predictions_of(_events(spark, sf)))
    rounded = averaged.withColumn("avg_confidence", F.round("avg_confidence", 10))
    return _windows(streams.drain_to_table(rounded, "confidence"))


@catalog.add("stream_latency_quantiles", f"""
WITH q AS ({REQUESTS}), w AS ({minute_windows("q", "count(*) AS n, count(*) FILTER (WHERE duration <= 0.5) AS fast")})
SELECT window_start, window_end, n, fast = n AS all_fast FROM w WHERE {_CLOSED}""")
def _(spark, sf):
    read = traffic.latency_quantiles(requests_of(_events(spark, sf)), quantiles={"p95": 0.95, "top": 1.0})
    checked = read.select("window_start", "window_end", "n", (F.col("top") <= 0.5).alias("all_fast"))
    return _windows(streams.drain_to_table(checked, "latency"))


@catalog.add("gauge_health", f"""
WITH g AS (SELECT ts, CAST(value < 150 AS INTEGER) AS gauge FROM events),
w AS ({minute_windows("g", "count(*) AS n, avg(gauge) AS a")})
SELECT window_start, window_end, n, round(a, 4) AS avg_gauge, a < 1 AS alert FROM w WHERE {_CLOSED}""")
def _(spark, sf):
    gauges = _events(spark, sf).select("ts", (F.col("value") < 150).cast("int").alias("gauge"))
    return _windows(streams.drain_to_table(traffic.gauge_below(gauges), "gauge"))


@catalog.add("stream_feedback_join", f"""
WITH p AS ({PREDICTIONS}),
f AS (SELECT prediction_id, ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) AS feedback_ts,
             CAST(value < 50 AS INTEGER) AS actual_outcome FROM p),
w AS (SELECT least(max(ts), max(feedback_ts)) - INTERVAL 10 MINUTE AS wm FROM p JOIN f USING (prediction_id))
SELECT f.prediction_id, f.feedback_ts, f.actual_outcome, p.prediction, p.prediction = f.actual_outcome AS was_correct
FROM f LEFT JOIN p ON p.prediction_id = f.prediction_id AND p.ts >= f.feedback_ts - INTERVAL 2 HOUR, w
WHERE p.prediction_id IS NOT NULL OR f.feedback_ts <= wm""")
def _(spark, sf):
    made = predictions_of(_events(spark, sf)).select("prediction_id", "ts", "prediction")
    raw = spark.readStream.schema(EVENT_SCHEMA).parquet(
        streams.as_stream_path(f"{sf}/events.parquet"))
    answered = F.timestamp_add("SECOND", F.floor(F.col("value") * 60).cast("int"), F.col("ts").cast("timestamp"))
    answers = raw.select(F.col("event_id").alias("prediction_id"), answered.alias("feedback_ts"),
                         (F.col("value") < 50).cast("int").alias("actual_outcome")).withWatermark("feedback_ts", DELAY)
    joined = streams.join_feedback_streams(made, answers, "2 HOURS")
    return _zoneless(streams.drain_to_table(joined, "feedback"), "feedback_ts")


@catalog.add("stream_drift", f"""
WITH p AS ({PREDICTIONS}), s AS (SELECT avg(CAST(prediction AS DOUBLE)) AS s1, avg(value) + 500 AS v, avg(k) AS k FROM p),
r AS (SELECT avg(value) AS vm, stddev_samp(value) AS vs, avg(k) AS km, stddev_samp(k) AS ks FROM p
      WHERE ts < TIMESTAMP '2024-01-15'),
z AS (SELECT (CAST(abs(v - vm) / vs > 2 AS INTEGER) + CAST(abs(k - km) / ks > 2 AS INTEGER)) / 2.0::DOUBLE AS ratio,
             round(abs(s1 - 0.5::DOUBLE), 4) AS score FROM s, r)
SELECT 0 AS batch_id, 'data_drift' AS alert_type, CASE WHEN ratio < 0.5 THEN 'warning' ELSE 'error' END AS severity,
       'Data Drift Detected' AS title FROM z WHERE ratio > 0.1
UNION ALL SELECT 0, 'prediction_drift', CASE WHEN score < 0.3 THEN 'warning' ELSE 'error' END, 'Prediction Drift Detected'
FROM z WHERE score > 0.1""")
def _(spark, sf):
    """Alert rows of one pass over the log, its first half being the reference."""
    early = predictions(spark, sf).where("ts < timestamp_ntz '2024-01-15'")
    features, alerts = scratch_path(spark, "drift-features"), scratch_path(spark, "drift-alerts")
    reference = column_moments(early.select("value", "k"))
    log = predictions_of(_events(spark, sf)).withColumn("value", F.col("value") + 500)
    streams.drain_batches(log, streams.drift_batch(reference, ["value", "k"], features, alerts), "drift")
    return spark.read.parquet(alerts).select("batch_id", "alert_type", "severity", "title")


# -- alert rules ----------------------------------------------------------------------------------


def _in_three_runs(spark, sf, states):
    """Events arrive in three files, every seventh one up to five minutes late; the alert query is started anew for each."""
    events = table(spark, sf, "events").withColumn("seen", F.col("ts") + F.when(F.col("event_id") % 7 == 0, F.expr("INTERVAL 5 MINUTES"))
                                                   .otherwise(F.expr("INTERVAL 0 MINUTES")))
    first, last = events.agg(F.min("seen"), F.max("seen")).first()
    cuts = [first + (last - first) * i / 3 for i in range(3)] + [None]
    log, sink, state = (scratch_path(spark, tag) for tag in ("alert-log", "alerts", "alert-state"))
    for low, high in zip(cuts, cuts[1:]):
        part = events.where(F.col("seen") >= F.lit(low)) if high is None else events.where((F.col("seen") >= F.lit(low)) & (F.col("seen") < F.lit(high)))
        part.drop("seen").write.mode("append").parquet(log)
        stream = streams.stream_log(spark, f"{log}/", EVENT_SCHEMA, "ts", delay=DELAY)
        alerting.start_alerts(states(stream), sink, state).awaitTermination()
    return spark.read.parquet(sink)


@catalog.add("stream_sustained", f"""
WITH q AS ({REQUESTS}),
w AS ({minute_windows("q", "count(*) AS n, count(*) FILTER (WHERE status >= 500) AS errors")}),
e AS (SELECT window_end, CAST(errors AS DOUBLE) / n > 0.05 AS bad FROM w WHERE {_CLOSED})
SELECT window_end, bad, count(*) FILTER (WHERE bad) OVER (ORDER BY window_end
       RANGE BETWEEN INTERVAL 10 MINUTE PRECEDING AND CURRENT ROW) = 11 AS firing FROM e""")
def _(spark, sf):
    """The batch operator's answer, from state carried over batches and restarts."""
    def states(events):
        windows = traffic.rolling(requests_of(events), "ts", "5 minutes", "1 minute", {
            "n": F.count(F.lit(1)), "errors": F.count_if(F.col("status").between(500, 599))}, event_time="at")
        named = windows.select(F.lit("errors").alias("rule"), "window_end", "at", (F.col("errors") / F.col("n") > 0.05).alias("bad"))
        return alerting.alert_states(named, "window_end", F.col("bad"), 10, event_time="at")

    rows = _in_three_runs(spark, sf, states).where(F.col("held").isNotNull())
    return _zoneless(rows.select("window_end", F.col("held").alias("bad"), "firing"), "window_end")


def _rule(name: str, source: str, sums: str, bad: str, hold: int) -> str:
    """States of one rule in SQL: the run each evaluation ends, and what follows a run."""
    return f"""
SELECT '{name}' AS rule, window_end, held, state FROM (
  WITH w AS ({minute_windows(source, sums)}), e AS (SELECT window_end, {bad} AS held FROM w WHERE {_CLOSED}),
  f AS (SELECT *, count(*) FILTER (WHERE held) OVER (ORDER BY window_end
               RANGE BETWEEN INTERVAL {hold} MINUTE PRECEDING AND CURRENT ROW) = {hold + 1} AS firing FROM e),
  g AS (SELECT *, lag(window_end) OVER o AS before, lag(firing) OVER o AS fired, lead(window_end) OVER o AS after FROM f
        WINDOW o AS (ORDER BY window_end))
  SELECT window_end, held, CASE WHEN held AND firing THEN 'firing' WHEN held THEN 'pending'
         WHEN fired AND before = window_end - INTERVAL 1 MINUTE THEN 'resolved' ELSE 'inactive' END AS state FROM g
  UNION ALL
  SELECT window_end + INTERVAL 1 MINUTE, NULL, CASE WHEN firing THEN 'resolved' ELSE 'inactive' END FROM g
  WHERE held AND coalesce(after > window_end + INTERVAL 1 MINUTE,
                          window_end + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE))"""


@catalog.add("stream_alert_rules", f"""
WITH q AS ({REQUESTS}), g AS (SELECT ts, CAST(value < 60 AS INTEGER) AS gauge FROM events)
{_rule("high_error_rate", "q", "count(*) AS n, count(*) FILTER (WHERE status >= 500) AS errors",
       "CAST(errors AS DOUBLE) / n > 0.05", 10)}
UNION ALL {_rule("high_latency_p95", "q", "count(*) AS n, count(*) FILTER (WHERE duration <= 0.25) AS fast",
                 "fast < n * 0.95::DOUBLE", 10)}
UNION ALL {_rule("model_not_loaded", "g", "avg(gauge) AS a", "a < 1", 5)}""")
def _(spark, sf):
    """All three rules in one query: inactive, pending, firing, resolved."""
    def states(events):
        gauges = events.select("ts", (F.col("value") < 60).cast("int").alias("gauge"))
        evaluated = alerting.window_evaluations(requests_of(events), gauges, p95_limit=0.25, floor=None)
        return alerting.alert_states(evaluated, "window_end", F.col("bad"), alerting.HOLD_MINUTES, event_time="at")

    return _zoneless(_in_three_runs(spark, sf, states).select("rule", "window_end", "held", "state"), "window_end")
