import datetime as dt

import pytest
from pyspark.sql import functions as F

from featurelake.functions import scalars
from featurelake.functions.histogram import quantile_from_counts
from featurelake.operators import predictions as preds
from featurelake.operators import runs, traffic


def requests(spark, rows):
    return spark.createDataFrame(
        [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), m, e, st, d) for i, (s, m, e, st, d) in enumerate(rows)],
        "request_id int, ts timestamp, method string, endpoint string, status int, duration double")


def test_index_percentiles(spark):
    df = requests(spark, [(i, "get", "/p", 200, i / 100) for i in range(100)])
    row = traffic.latency_summary(df).first()
    assert (row.p95_ms, row.p99_ms, row.min_ms, row.max_ms, row.avg_ms) == (950.0, 990.0, 0.0, 990.0, 495.0)
    last = traffic.latency_summary(df, samples=10).first()
    assert (last.samples, last.min_ms, last.p95_ms) == (10, 900.0, 990.0)
    assert traffic.latency_summary(df.limit(0)).count() == 0


def test_request_defaults(spark):
    df = requests(spark, [(0, None, None, 200, -1.0), (1, "", "", 200, 1.0), (2, "get", "/p", 500, 1.0)])
    assert {r.request: r.n for r in traffic.requests_by_endpoint(df).collect()} == {"UNKNOWN unknown": 2, "GET /p": 1}
    assert {r.status: r.n for r in traffic.requests_by_status(df).collect()} == {200: 2, 500: 1}
    assert traffic.latency_summary(df).first().min_ms == 0.0


def test_requests_per_second(spark):
    df = requests(spark, [(0, "get", "/", 200, 0.1), (10, "get", "/", 200, 0.1)])
    assert traffic.requests_per_second(df).first().rps == 0.2
    assert traffic.requests_per_second(df.limit(1)).first().rps == 0.0


def test_error_ratio_has_a_floor(spark):
    df = requests(spark, [(0, "get", "/", 500, 0.1)])
    row = traffic.error_ratio(df, slide="5 minutes").first()
    assert row.error_ratio == round(1 / 300, 4) and not row.alert
    assert traffic.error_ratio(df, slide="5 minutes", floor=None).first().alert


def test_sliding_windows_equal_the_builtin(spark):
    df = requests(spark, [(i * 37, "get", "/", 200, 0.1) for i in range(200)])
    got = {(r.window_start, r.n) for r in traffic.request_rate(df).collect()}
    direct = df.groupBy(F.window("ts", "5 minutes", "1 minute").alias("w")).count()
    assert got == {(r.w.start, r["count"]) for r in direct.collect()}


def test_quantile_interpolates_inside_the_bucket(spark):
    counts = spark.createDataFrame([(0, 10, 20, 20)], "le_0 long, le_1 long, le_2 long, le_3 long")
    bounds = [1.0, 2.0, 4.0]
    read = counts.select(*[quantile_from_counts(q, bounds).alias(f"q{i}") for i, q in enumerate([0.25, 0.5, 0.75, 1.0])])
    assert list(read.first()) == [1.5, 2.0, 3.0, 4.0]
    open_end = spark.createDataFrame([(0, 0, 0, 5)], counts.schema).select(quantile_from_counts(0.5, bounds).alias("q"))
    assert open_end.first().q == 4.0
    empty = spark.createDataFrame([(0, 0, 0, 0)], counts.schema).select(quantile_from_counts(0.5, bounds).alias("q"))
    assert empty.first().q is None


@pytest.mark.parametrize("width", [3, 10_080])
def test_sustained_needs_every_step(spark, width):
    start = dt.datetime(2024, 1, 1)
    bad = [1, 1, 1, 1, 0, 1, 1, 1, None, 1, 1, 1, 1]
    rows = [(start + dt.timedelta(minutes=i), bool(b)) for i, b in enumerate(bad) if b is not None]
    out = traffic.sustained(spark.createDataFrame(rows, "t timestamp, bad boolean"), "t", "bad", 3, width=width)
    firing = sorted(r.t for r in out.where("firing").collect())
    assert firing == [start + dt.timedelta(minutes=m) for m in (3, 12)]
    assert out.count() == len(rows)


def test_access_stats_window(spark):
    log = spark.createDataFrame([("t", "a", dt.datetime(2024, 1, 10)), ("t", "a", dt.datetime(2024, 1, 9)),
                                 ("t", "b", dt.datetime(2024, 1, 1)), ("u", "a", dt.datetime(2024, 1, 10))],
                                "table_name string, entity_id string, accessed_at timestamp")
    out = {r.table_name: (r.access_count, r.unique_entities) for r in traffic.access_stats(log).collect()}
    assert out == {"t": (2, 1), "u": (1, 1)}
    assert traffic.access_stats(log, days=30, table="t").first().unique_entities == 2


def test_jobs(spark):
    now = dt.datetime(2024, 1, 10)
    log = spark.createDataFrame([(1, "training", dt.datetime(2024, 1, 1), -5.0, True, 0), (2, "training", now, 3.0, False, 1)],
                                "run_id int, job string, ts timestamp, duration double, success boolean, exit_code int")
    rec = traffic.job_run_records(log, "app_", {"last f1": F.lit(0.5)})
    assert [r.last_duration for r in rec.orderBy("last_run").collect()] == [0.0, 3.0]
    assert rec.first().metrics == {"app_last_f1": 0.5}
    expected = spark.createDataFrame([("training", 691200), ("monitoring", 28800)], "job string, max_age_seconds long")
    stale = {r.job: (r.age_seconds, r.stale) for r in traffic.stale_jobs(rec.where("last_success = 1"), expected, now).collect()}
    assert stale == {"training": (777600, True), "monitoring": (None, True)}
    fresh = {r.job: r.stale for r in traffic.stale_jobs(rec, expected, now).collect()}
    assert fresh == {"training": False, "monitoring": True}
    last = traffic.failed_jobs(rec.withColumn("run_id", F.lit(1))).first()
    assert last.failed and last.last_duration == 3.0


# -- prediction log ----------------------------------------------------------------------------------


def log(spark, classes, confidence=0.7):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), c, "x", confidence) for i, c in enumerate(classes)]
    return spark.createDataFrame(rows, "prediction_id int, ts timestamp, prediction int, label string, confidence double")


@pytest.mark.parametrize("confidence,expected", [(1.0, 20), (0.0, 1), (0.05, 2), (1.3, 20)])
def test_confidence_bins(spark, confidence, expected):
    assert preds.confidence_histogram(log(spark, [1], confidence)).first()["bin"] == expected


def test_cumulative_histogram_clamps(spark):
    out = {r["le"]: r.n for r in preds.confidence_cumulative(log(spark, [1, 0], 1.7)).collect()}
    assert out["1.0"] == 2 and out["0.95"] == 0 and out["+Inf"] == 2 and len(out) == 9


@pytest.mark.parametrize("width", [60, 100_000])
def test_rolling_ratio_excludes_the_current_row(spark, width):
    classes = [i % 3 == 0 for i in range(130)]
    out = preds.rolling_class_ratio(log(spark, [int(c) for c in classes]), width=width).orderBy("idx").collect()
    assert [r.idx for r in out] == list(range(50, 130))
    assert [r.class_1_ratio for r in out] == [round(sum(classes[i - 50:i]) / 50, 4) for i in range(50, 130)]


def test_short_window_needs_more_than_ten_rows(spark):
    assert preds.recent_class_ratio(log(spark, [1] * 10)).count() == 0
    row = preds.recent_class_ratio(log(spark, [1] * 11)).first()
    assert row.possible_drift and row.delta == 0.5


def test_unmatched_feedback_stays_and_does_not_count(spark):
    feedback = spark.createDataFrame([(1, 1), (2, 1), (99, 0)], "prediction_id int, actual_outcome int")
    matched = preds.join_feedback(feedback, log(spark, [0, 1, 0]))
    assert {r.prediction_id: r.was_correct for r in matched.collect()} == {1: True, 2: False, 99: None}
    row = preds.production_accuracy(matched).first()
    assert (row.total_feedbacks, row.correct_predictions, row.production_accuracy) == (2, 1, 0.5)
    assert preds.production_accuracy(matched.limit(0)).first().production_accuracy == 0.0
    recent = preds.join_feedback(feedback, log(spark, [0, 1, 0]), recent=1)
    assert {r.prediction_id: r.was_correct for r in recent.collect()} == {1: None, 2: False, 99: None}


def test_first_prediction_of_an_id_counts(spark):
    twice = log(spark, [0, 1]).withColumn("prediction_id", F.lit(5))
    feedback = spark.createDataFrame([(5, 0)], "prediction_id int, actual_outcome int")
    assert preds.join_feedback(feedback, twice).first().was_correct


# -- expressions and run log ---------------------------------------------------------------------------


def test_metric_names(spark):
    names = ["f1 score", "9lives", "", "app_x", " a-b:c "]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.m for r in df.select(scalars.metric_name(F.col("n"), "app_").alias("m")).collect()]
    assert got == ["app_f1_score", "app_9lives", "app_job_metric", "app_x", "app_a-b:c".replace("-", "_")]
    assert spark.range(1).select(scalars.feature_metric_name(F.lit("a (b) c")).alias("m")).first().m == "a_b_c"


def test_switches_and_ids(spark):
    df = spark.createDataFrame([("Yes",), ("off",), (None,), (" ON ",)], "s string")
    assert [r.t for r in df.select(scalars.truthy(F.col("s"), True).alias("t")).collect()] == [True, False, True, True]
    row = spark.range(1).select(scalars.parse_id_list(F.lit("1, 2,x")).alias("p")).first().p
    assert row.ids == [1, 2, None] and not row.valid


def test_log_defaults(spark):
    df = spark.createDataFrame([("  ", None, "", "mod"), ("hit", "text", "api", None)],
                               "event string, message string, component string, module string")
    out = df.select(*[c.alias(n) for n, c in scalars.log_defaults({c: F.col(c) for c in df.columns}, "svc", "dev").items()])
    first, second = out.collect()
    assert (first.event, first.message, first.component, first.service) == ("log", "log", "mod", "svc")
    assert (second.message, second.component, second.trace_id) == ("text", "api", None)


def test_versions_sort_as_numbers(spark):
    df = spark.createDataFrame([("m", "9", 1, "None"), ("m", "10", 2, "None"), ("m", "2", 3, "Production")],
                               "name string, version string, run_id int, stage string")
    assert [r["version"] for r in runs.newest_first(df, "m").collect()] == ["10", "9", "2"]
    assert {r.stage: r["version"] for r in runs.latest_per_stage(df).collect()} == {"None": "10", "Production": "2"}
    pointers = spark.createDataFrame([("m", "9", "Production")], "name string, version string, stage string")
    assert {r["version"]: r.stage for r in runs.version_details(df, pointers).collect()} == {
        "9": "Production", "10": "None", "2": "Production"}


def test_best_run_without_the_metric(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), {"f1": 0.5}), (2, dt.datetime(2024, 1, 2), {"f1": 0.9}),
                                (3, dt.datetime(2024, 1, 3), {})], "run_id int, start_time timestamp, metrics map<string,double>")
    assert runs.best_run(df, "f1").first().run_id == 2
    assert runs.best_run(df, "f1", ascending=True).first().run_id == 1
    assert runs.best_run(df, "nope").count() == 0
    assert [r.run_id for r in runs.recent_runs(df, 2).collect()] == [3, 2]
