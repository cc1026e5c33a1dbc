"""Queries on profiles, drift, the prediction log and request traffic."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from featurelake.catalog.bindings import (ALERTS, CURRENT, DOCUMENT_PREDICTIONS, DRIFT_COLUMNS, ENTITIES, FEEDBACK,
                                          LOG_LINES, PREDICTIONS, REFERENCE, REQUESTS, Catalog, alerts, current_frame,
                                          document_predictions, entities, feedback, log_lines, predictions,
                                          reference_frame, requests, table)
from featurelake.functions import scalars
from featurelake.operators import alerts as alerting
from featurelake.operators import drift, rollups, traffic
from featurelake.operators import predictions as preds
from featurelake.operators.profile import column_moments, dataset_profile
from featurelake.plans.monitoring import monitoring_job
from featurelake.session import scratch_path
from featurelake.streaming.streams import drop_late, search_logs

catalog = Catalog()


# -- profile ---------------------------------------------------------------------------------------

_PROFILE_NUMBERS = {"customer_id": "bigint", "acctbal": "double", "spend": "double", "n_orders": "bigint"}
_PROFILE_TEXTS = ["segment", "nation"]
_PROFILE = list(_PROFILE_NUMBERS) + _PROFILE_TEXTS


def _profile_sql() -> str:
    rows = []
    for c in _PROFILE:
        nulls = f"count(*) FILTER (WHERE {c} IS NULL)"
        if c in _PROFILE_NUMBERS:
            stats = (f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
                     f"round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max, "
                     f"CAST(NULL AS BIGINT) AS unique_count")
        else:
            stats = ("CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, "
                     f"CAST(NULL AS DOUBLE) AS max, count(DISTINCT {c}) AS unique_count")
        rows.append(f"""SELECT count(*) AS num_rows, {len(_PROFILE)} AS num_columns, '{c}' AS "column",
            '{_PROFILE_NUMBERS.get(c, "string")}' AS dtype, {nulls} AS null_count,
            round(100.0::DOUBLE * {nulls} / count(*), 2) AS null_pct, {stats} FROM e""")
    return " UNION ALL ".join(rows)


@catalog.add("dataset_profile", f"WITH e AS ({ENTITIES}) {_profile_sql()}")
def _(spark, sf):
    return dataset_profile(entities(spark, sf).select(*_PROFILE))


# -- drift -----------------------------------------------------------------------------------------


def _drift_sql(reference: str, current: str, columns) -> str:
    parts = [f"""SELECT '{c}' AS feature, (SELECT avg({c}) FROM {reference}) AS rm,
                        (SELECT stddev_samp({c}) FROM {reference}) AS rs, (SELECT avg({c}) FROM {current}) AS cm"""
             for c in columns]
    return f"""
SELECT feature, rm, cm, CASE WHEN coalesce(rs, 0) > 0 AND cm IS NOT NULL THEN abs(cm - rm) / rs ELSE 0 END AS z
FROM ({" UNION ALL ".join(parts)})"""


_BOTH = f"WITH r AS ({REFERENCE}), c AS ({CURRENT}), d AS ({_drift_sql('r', 'c', DRIFT_COLUMNS)})"
_SUMMARY_COLUMNS = """count(*) AS features_analyzed, count(*) FILTER (WHERE z > 2) AS features_with_drift,
       round(CAST(count(*) FILTER (WHERE z > 2) AS DOUBLE) / count(*), 4) AS drift_ratio,
       CAST(count(*) FILTER (WHERE z > 2) AS DOUBLE) / count(*) > 0.1 AS drift_detected"""


def _features(spark, sf):
    return drift.drift_features(column_moments(reference_frame(spark, sf)), current_frame(spark, sf))


@catalog.add("data_drift_features", f"""{_BOTH}
SELECT feature, round(rm, 4) AS ref_mean, round(cm, 4) AS cur_mean, round(z, 4) AS z_score, z > 2 AS drift FROM d""")
def _(spark, sf):
    return _features(spark, sf)


@catalog.add("data_drift_summary", f"{_BOTH} SELECT {_SUMMARY_COLUMNS} FROM d")
def _(spark, sf):
    return drift.drift_summary(_features(spark, sf))


@catalog.add("prediction_drift", f"""
WITH p AS ({PREDICTIONS}), s AS (SELECT count(*) AS n, avg(CAST(prediction AS DOUBLE)) AS s1 FROM p)
SELECT n AS sample_size, round(1 - s1, 4) AS class_0_share, round(s1, 4) AS class_1_share,
       round(abs(s1 - 0.5::DOUBLE), 4) AS drift_score, abs(s1 - 0.5::DOUBLE) > 0.1 AS drift_detected FROM s""")
def _(spark, sf):
    return drift.prediction_drift(predictions(spark, sf)).drop("exact_score")


# The inputs' reference is the log's first half by time.
_HALF = "2024-01-15"
_INPUTS = ["value", "k"]


def _early(spark, sf):
    rows = predictions(spark, sf).where(F.col("ts") < F.lit(_HALF).cast("timestamp_ntz"))
    return column_moments(rows.select(*_INPUTS))


_RECENT = f"""
WITH p AS ({PREDICTIONS}), early AS (SELECT * FROM p WHERE ts < TIMESTAMP '{_HALF}'),
recent AS (SELECT * FROM p ORDER BY ts DESC, prediction_id DESC LIMIT {{n}}),
d AS ({_drift_sql('early', 'recent', _INPUTS)}),
f AS (SELECT {_SUMMARY_COLUMNS} FROM d),
s AS (SELECT count(*) AS n, sum(prediction)::BIGINT AS ones, avg(CAST(prediction AS DOUBLE)) AS s1 FROM recent)"""
_RECENT_COLUMNS = """n AS window_size, n - ones AS class_0_count, ones AS class_1_count, round(s1, 4) AS class_1_ratio,
       round(abs(s1 - 0.5::DOUBLE), 4) AS prediction_drift_score, abs(s1 - 0.5::DOUBLE) > 0.1 AS prediction_drift,
       features_analyzed, features_with_drift, drift_ratio, drift_detected AS data_drift"""


@catalog.add("recent_window_summary", f"{_RECENT.format(n=1000)} SELECT {_RECENT_COLUMNS} FROM s, f")
def _(spark, sf):
    recent = preds.latest(predictions(spark, sf), n=1000)
    return drift.recent_summary(recent, _early(spark, sf), _INPUTS)


@catalog.add("monitoring_check", f"""
{_RECENT.format(n=100)}, w AS (SELECT count(*) AS m, avg(CAST(prediction AS DOUBLE)) AS a1 FROM p)
SELECT {_RECENT_COLUMNS}, m AS all_predictions, a1 < 0.1 OR a1 > 0.9 AS out_of_bounds,
       drift_detected OR abs(s1 - 0.5::DOUBLE) > 0.1 OR a1 < 0.1 OR a1 > 0.9 AS has_alert,
       drift_detected OR abs(s1 - 0.5::DOUBLE) > 0.1 AS retrain,
       CAST(drift_detected OR abs(s1 - 0.5::DOUBLE) > 0.1 OR a1 < 0.1 OR a1 > 0.9 AS INTEGER) AS exit_code
FROM s, f, w""")
def _(spark, sf):
    return monitoring_job(predictions(spark, sf), _early(spark, sf), _INPUTS, fail_on_alert=True).summary


# One drift check per day of the log, each against the first half.
_DAILY = f"""
WITH p AS ({PREDICTIONS}), early AS (SELECT * FROM p WHERE ts < TIMESTAMP '{_HALF}'),
ref AS (SELECT avg(value) AS vm, stddev_samp(value) AS vs, avg(k) AS km, stddev_samp(k) AS ks FROM early),
daily AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, avg(value) AS value, avg(k) AS k FROM p GROUP BY 1),
checked AS (SELECT day, n, CAST(abs(value - vm) / vs > 0.05 AS INTEGER) + CAST(abs(k - km) / ks > 0.05 AS INTEGER)
                   AS drifted FROM daily, ref)"""


@catalog.add("drift_report", f"""{_DAILY}
SELECT day, n, 2 AS features_analyzed, drifted AS features_with_drift, (SELECT count(*) FROM checked) AS history_count,
       2 AS features_covered FROM checked ORDER BY day DESC LIMIT 10""")
def _(spark, sf):
    ref = {r["feature"]: (r["mean"], r["std"]) for r in _early(spark, sf).collect()}
    daily = predictions(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in _INPUTS])
    far = [(F.abs(F.col(c) - F.lit(m)) / F.lit(s) > 0.05).cast("int") for c, (m, s) in ref.items()]
    events = daily.select("day", "n", F.lit(len(far)).alias("features_analyzed"), sum(far).alias("features_with_drift"))
    return drift.drift_report(events, "day", "n")


@catalog.add("drift_report_full", f"""{_DAILY}
SELECT day, n, CAST(2 AS BIGINT) AS features_analyzed, CAST(drifted AS BIGINT) AS features_with_drift, round(drifted / 2.0::DOUBLE, 4) AS drift_ratio,
       drifted / 2.0::DOUBLE > 0.1 AS drift_detected, (SELECT count(*) FROM checked) AS history_count, 2 AS features_covered,
       'k,value' AS reference_features, 0.1::DOUBLE AS drift_threshold FROM checked ORDER BY day DESC LIMIT 10""")
def _(spark, sf):
    """The report over a stored table of daily drift summaries, with the features and the threshold it rests on."""
    path = scratch_path(spark, "drift-history")
    reference = _early(spark, sf)
    daily = predictions(spark, sf).withColumn("day", F.to_date("ts"))
    drift.drift_by_period(reference, daily, "day", _INPUTS, 0.05).write.parquet(path)
    names = sorted(r["feature"] for r in reference.select("feature").collect())  # one row per feature
    report = drift.drift_report(spark.read.parquet(path), "day", "n", features=names)
    return report.withColumn("reference_features", F.concat_ws(",", "reference_features"))


@catalog.add("class_ratio_bounds", f"""
WITH p AS ({PREDICTIONS}), s AS (SELECT count(*) AS n, sum(prediction)::BIGINT AS ones FROM p)
SELECT n AS total, ones AS class_1_count, round(CAST(ones AS DOUBLE) / n, 6) AS class_1_ratio,
       CAST(ones AS DOUBLE) / n < 0.1 OR CAST(ones AS DOUBLE) / n > 0.9 AS out_of_bounds FROM s""")
def _(spark, sf):
    return drift.class_ratio_bounds(predictions(spark, sf))


@catalog.add("alert_rows", f"""
{_BOTH}, f AS (SELECT {_SUMMARY_COLUMNS} FROM d), p AS ({PREDICTIONS}),
s AS (SELECT abs(avg(CAST(prediction AS DOUBLE)) - 0.5) AS score, avg(CAST(prediction AS DOUBLE)) AS s1 FROM p)
SELECT 'data_drift' AS alert_type, CASE WHEN drift_ratio < 0.5 THEN 'warning' ELSE 'error' END AS severity,
       'Data Drift Detected' AS title, CAST(drift_ratio AS DOUBLE) AS measure FROM f WHERE drift_detected
UNION ALL
SELECT 'prediction_drift', CASE WHEN score < 0.3 THEN 'warning' ELSE 'error' END,
       'Prediction Drift Detected', round(score, 4) FROM s WHERE score > 0.1""")
def _(spark, sf):
    rows = alerting.alerts_from_drift(drift.drift_summary(_features(spark, sf)),
                                      drift.prediction_drift(predictions(spark, sf)), F.current_timestamp())
    meta = F.col("metadata")
    measure = F.coalesce(F.try_element_at(meta, F.lit("drift_ratio")), F.try_element_at(meta, F.lit("drift_score")))
    return rows.select("alert_type", "severity", "title", measure.cast("double").alias("measure"))


@catalog.add("alert_history", f"""
WITH a AS ({ALERTS}), kept AS (SELECT * FROM a)
SELECT alert_id, ts, alert_type, severity FROM kept WHERE alert_type = 'data_drift' AND severity = 'warning'
ORDER BY ts DESC, alert_id DESC LIMIT 100""")
def _(spark, sf):
    return alerting.alert_history(alerts(spark, sf), "ts", "alert_id", "data_drift", "warning").select(
        "alert_id", "ts", "alert_type", "severity")


# -- prediction log --------------------------------------------------------------------------------


@catalog.add("label_counts", f"WITH p AS ({PREDICTIONS}) SELECT label, count(*) AS n FROM p GROUP BY label")
def _(spark, sf):
    return preds.label_counts(predictions(spark, sf))


@catalog.add("daily_counts", f"""
WITH p AS ({PREDICTIONS}) SELECT CAST(ts AS DATE) AS day, label, count(*) AS n FROM p GROUP BY 1, 2""")
def _(spark, sf):
    return preds.daily_counts(predictions(spark, sf))


@catalog.add("confidence_histogram", f"""
WITH p AS ({PREDICTIONS})
SELECT label, least(CAST(floor(confidence * 20) AS BIGINT) + 1, 20) AS bin, count(*) AS n FROM p GROUP BY 1, 2""")
def _(spark, sf):
    return preds.confidence_histogram(predictions(spark, sf))


_BOUNDS = ["0.0", "0.2", "0.4", "0.6", "0.8", "0.9", "0.95", "1.0"]


@catalog.add("confidence_cumulative_hist", f"WITH p AS ({PREDICTIONS}) " + " UNION ALL ".join(
    [f"SELECT '{b}' AS le, count(*) FILTER (WHERE greatest(least(confidence, 1), 0) <= {b}::DOUBLE) AS n FROM p"
     for b in _BOUNDS] + ["SELECT '+Inf', count(*) FROM p"]))
def _(spark, sf):
    return preds.confidence_cumulative(predictions(spark, sf))


@catalog.add("prediction_distribution", f"""
WITH p AS ({PREDICTIONS}), s AS (SELECT count(*) AS n, sum(prediction)::BIGINT AS ones FROM p)
SELECT n AS total_predictions, n - ones AS class_0, ones AS class_1,
       round(100.0::DOUBLE * (n - ones) / n, 2) AS class_0_pct, round(100.0::DOUBLE * ones / n, 2) AS class_1_pct FROM s""")
def _(spark, sf):
    return preds.prediction_distribution(predictions(spark, sf))


@catalog.add("latest_predictions", f"""
WITH p AS ({PREDICTIONS}) SELECT prediction_id, ts, label FROM p ORDER BY ts DESC, prediction_id DESC LIMIT 10""")
def _(spark, sf):
    return preds.latest(predictions(spark, sf)).select("prediction_id", "ts", "label")


@catalog.add("recent_class_ratio", f"""
WITH p AS ({PREDICTIONS}), r AS (SELECT * FROM p ORDER BY ts DESC, prediction_id DESC LIMIT 100),
s AS (SELECT count(*) AS n, avg(CAST(prediction AS DOUBLE)) AS s1 FROM r)
SELECT n AS analyzed, round(s1, 4) AS class_1_ratio, round(s1 - 0.5::DOUBLE, 4) AS delta,
       abs(s1 - 0.5::DOUBLE) > 0.2 AS possible_drift FROM s WHERE n > 10""")
def _(spark, sf):
    return preds.recent_class_ratio(predictions(spark, sf))


@catalog.add("rolling_class_ratio", f"""
WITH p AS ({PREDICTIONS}),
w AS (SELECT prediction_id, row_number() OVER (ORDER BY ts, prediction_id) - 1 AS idx,
             round(avg(CAST(prediction AS DOUBLE)) OVER (ORDER BY ts, prediction_id
                   ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), 4) AS class_1_ratio FROM p)
SELECT prediction_id, idx, class_1_ratio, class_1_ratio BETWEEN 0.3 AND 0.7 AS in_bounds FROM w WHERE idx >= 50""")
def _(spark, sf):
    return preds.rolling_class_ratio(predictions(spark, sf))


@catalog.add("feedback_join", f"""
WITH p AS ({DOCUMENT_PREDICTIONS}), recent AS (SELECT * FROM p),
f AS ({FEEDBACK})
SELECT f.prediction_id, f.actual_outcome, recent.prediction, recent.prediction = f.actual_outcome AS was_correct
FROM f LEFT JOIN recent USING (prediction_id)""")
def _(spark, sf):
    return preds.join_feedback(feedback(spark, sf), document_predictions(spark, sf))


@catalog.add("production_accuracy", f"""
WITH p AS ({DOCUMENT_PREDICTIONS}), f AS ({FEEDBACK})
SELECT count(*) AS total_feedbacks, count(*) FILTER (WHERE prediction = actual_outcome) AS correct_predictions,
       round(CAST(count(*) FILTER (WHERE prediction = actual_outcome) AS DOUBLE) / count(*), 4) AS production_accuracy
FROM f JOIN p USING (prediction_id)""")
def _(spark, sf):
    return preds.production_accuracy(
        preds.join_feedback(feedback(spark, sf), document_predictions(spark, sf), recent=None))


# -- traffic ---------------------------------------------------------------------------------------


@catalog.add("requests_by_endpoint", f"""
WITH q AS ({REQUESTS})
SELECT upper(coalesce(method, 'unknown')) || ' ' || endpoint AS request, count(*) AS n FROM q GROUP BY 1""")
def _(spark, sf):
    return traffic.requests_by_endpoint(requests(spark, sf))


@catalog.add("requests_by_status", f"WITH q AS ({REQUESTS}) SELECT status, count(*) AS n FROM q GROUP BY status")
def _(spark, sf):
    return traffic.requests_by_status(requests(spark, sf))


@catalog.add("latency_summary", f"""
WITH q AS ({REQUESTS}),
r AS (SELECT greatest(duration, 0) AS d FROM q),
o AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM r)
SELECT count(*) AS samples, round(avg(d) * 1000, 2) AS avg_ms, round(min(d) * 1000, 2) AS min_ms,
       round(max(d) * 1000, 2) AS max_ms,
       round(max(d) FILTER (WHERE i = CAST(floor(n * 0.95::DOUBLE) AS BIGINT)) * 1000, 2) AS p95_ms,
       round(max(d) FILTER (WHERE i = CAST(floor(n * 0.99::DOUBLE) AS BIGINT)) * 1000, 2) AS p99_ms FROM o""")
def _(spark, sf):
    return traffic.latency_summary(requests(spark, sf))


@catalog.add("requests_per_second", """
SELECT count(*) AS total_requests,
       round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE), 4) AS rps FROM events""")
def _(spark, sf):
    return traffic.requests_per_second(requests(spark, sf))


@catalog.add("access_stats", """
SELECT event_type AS table_name, count(*) AS access_count, count(DISTINCT user_id) AS unique_entities
FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY event_type""")
def _(spark, sf):
    log = table(spark, sf, "events").select(
        F.col("event_type").alias("table_name"), F.col("user_id").alias("entity_id"), F.col("ts").alias("accessed_at"))
    return traffic.access_stats(log)


@catalog.add("access_stats_rollup", """
WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, user_id FROM events), newest AS (SELECT max(day) AS last FROM d)
SELECT CAST(n AS INTEGER) AS days, event_type AS table_name, count(*) AS access_count, count(DISTINCT user_id) AS unique_entities
FROM d, newest, (SELECT unnest([1, 7, 30]) AS n) WHERE day > last - CAST(n AS INTEGER) GROUP BY n, event_type""")
def _(spark, sf):
    """Distinct entities of 1, 7 and 30 days, united from one bitmap per day; the log itself is read once."""
    log = table(spark, sf, "events").select(
        F.col("event_type").alias("table_name"), F.col("user_id").alias("entity_number"), F.col("ts").alias("accessed_at"))
    state = rollups.access_state(spark, scratch_path(spark, "accesses"))
    last = max(state.replace(rollups.day_accesses(log)))
    parts = [rollups.access_rollup(state, date.fromisoformat(last), n).select(F.lit(n).alias("days"), "*") for n in (1, 7, 30)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@catalog.add("late_data_filter", """
SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 168 HOUR""")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts")
    newest = events.agg(F.max("ts")).first()[0]
    return drop_late(events, "ts", now=scalars.literal(newest, events.schema["ts"].dataType))


def minute_windows(source: str, aggregates: str, length: int = 5, slide: int = 1) -> str:
    """SQL for sliding windows: every row is assigned to all windows covering it."""
    return f"""
SELECT window_start, window_start + INTERVAL {length} MINUTE AS window_end, {aggregates}
FROM (SELECT q.*, time_bucket(INTERVAL {slide} MINUTE, ts) - INTERVAL (s * {slide}) MINUTE AS window_start
      FROM {source} q, (SELECT unnest(range({length // slide})) AS s))
GROUP BY window_start"""


@catalog.add("sustained_condition", f"""
WITH q AS ({REQUESTS}),
w AS ({minute_windows("q", "count(*) AS n, count(*) FILTER (WHERE status >= 500) AS errors")}),
e AS (SELECT window_end, CAST(errors AS DOUBLE) / n > 0.05 AS bad FROM w)
SELECT window_end, bad, count(*) FILTER (WHERE bad) OVER (ORDER BY window_end
       RANGE BETWEEN INTERVAL 10 MINUTE PRECEDING AND CURRENT ROW) = 11 AS firing FROM e""")
def _(spark, sf):
    evaluated = traffic.error_ratio(requests(spark, sf), floor=None).select("window_end", F.col("alert").alias("bad"))
    return traffic.sustained(evaluated, "window_end", "bad", 10)


@catalog.add("histogram_quantile", f"""
WITH q AS (SELECT * FROM ({REQUESTS})),
b AS (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]::DOUBLE[]) AS le),
hours AS (SELECT date_trunc('hour', ts) AS window_start, duration FROM q),
totals AS (SELECT window_start, count(*) AS n FROM hours GROUP BY 1),
c AS (SELECT window_start, le, count(*) FILTER (WHERE duration <= le) AS upto FROM hours, b GROUP BY 1, 2),
steps AS (SELECT window_start, le, upto, lag(le, 1, 0.0) OVER o AS lo, lag(upto, 1, 0) OVER o AS below FROM c
          WINDOW o AS (PARTITION BY window_start ORDER BY le)),
hit AS (SELECT window_start, n, quantile, arg_min(CASE WHEN upto > below
               THEN lo + (le - lo) * (n * quantile - below) / (upto - below) ELSE lo END, le) AS v
        FROM steps JOIN totals USING (window_start), (SELECT unnest([0.95, 0.99]::DOUBLE[]) AS quantile)
        WHERE upto >= n * quantile GROUP BY 1, 2, 3)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, n,
       round(max(v) FILTER (WHERE quantile < 0.97), 10) AS p95, round(max(v) FILTER (WHERE quantile > 0.97), 10) AS p99,
       max(v) FILTER (WHERE quantile < 0.97) > 1 AS alert
FROM hit GROUP BY 1, 2, 3""")
def _(spark, sf):
    read = traffic.latency_quantiles(requests(spark, sf), length="1 hour", slide="1 hour")
    return read.withColumns({q: F.round(q, 10) for q in ("p95", "p99")})


# -- log lines -------------------------------------------------------------------------------------


@catalog.add("log_body_parse", f"""
WITH l AS ({LOG_LINES})
SELECT event_id, coalesce(body LIKE '{{%', false) AS is_json,
       CASE WHEN body LIKE '{{%' THEN CAST(json_extract_string(body, '$.k') AS INTEGER) END AS k FROM l""")
def _(spark, sf):
    parsed = scalars.parse_json_body(F.col("body"))
    return log_lines(spark, sf).select(
        "event_id", parsed.isNotNull().alias("is_json"), F.variant_get(parsed, "$.k", "int").alias("k"))


@catalog.add("log_schema_defaults", f"""
WITH l AS ({LOG_LINES}), x AS (
  SELECT event_id, CASE WHEN value < 10 THEN '  ' WHEN value < 200 THEN event_type END AS event, service,
         CASE WHEN value < 30 THEN '' WHEN value < 60 THEN 'api' END AS component,
         CASE WHEN event_type = 'click' THEN 'web' END AS logger FROM l)
SELECT event_id, coalesce(nullif(trim(event), ''), 'log') AS event, coalesce(nullif(trim(event), ''), 'log') AS message,
       coalesce(service, 'featurelake') AS service, 'test' AS environment,
       coalesce(nullif(component, ''), logger, 'application') AS component, CAST(NULL AS VARCHAR) AS trace_id FROM x""")
def _(spark, sf):
    value = F.col("value")
    lines = log_lines(spark, sf).select(
        "event_id", F.when(value < 10, "  ").when(value < 200, F.col("event_type")).alias("event"), "service",
        F.when(value < 30, "").when(value < 60, "api").alias("component"),
        F.when(F.col("event_type") == "click", "web").alias("logger"))
    have = {c: F.col(c) for c in lines.columns if c != "event_id"}
    full = lines.withColumns(scalars.log_defaults(have, "featurelake", "test"))
    return full.select("event_id", "event", "message", "service", "environment", "component", "trace_id")


@catalog.add("log_search", f"""
WITH l AS ({LOG_LINES})
SELECT event_id, body, CASE WHEN body LIKE '{{%' THEN json_extract_string(body, '$.k') END AS k
FROM l WHERE service = 'scoring'""")
def _(spark, sf):
    return search_logs(log_lines(spark, sf), "scoring", ["k"]).select("event_id", "body", "k")


@catalog.add("id_list_parse", """
WITH x AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 'x' ELSE CAST(event_id + 1 AS VARCHAR) END AS t
           FROM events)
SELECT event_id, CAST(CASE WHEN t = 'x' THEN 2 ELSE 3 END AS BIGINT) AS n_ids,
       CAST(event_id + user_id + CASE WHEN t = 'x' THEN 0 ELSE event_id + 1 END AS BIGINT) AS id_sum, t <> 'x' AS valid
FROM x""")
def _(spark, sf):
    text = F.concat_ws(
        ",", F.col("event_id").cast("string"), F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" ")),
        F.when(F.col("event_type") == "error", "x").otherwise((F.col("event_id") + 1).cast("string")))
    parsed = table(spark, sf, "events").select("event_id", scalars.parse_id_list(text).alias("p"))
    known = F.array_compact("p.ids")
    return parsed.select("event_id", F.size(known).cast("bigint").alias("n_ids"),
                         F.aggregate(known, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"), "p.valid")
