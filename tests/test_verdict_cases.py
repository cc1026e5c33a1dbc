"""Golden cases: missing numbers, caps, exact limits, times and versions that are absent, letters beyond Latin."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from featurelake.functions import ordering, scalars
from featurelake.operators import alerts, drift, predictions, prepare, profile, runs, traffic
from featurelake.plans.monitoring import monitoring_job
from featurelake.sources.serving import ServingStore

NAN, INF = float("nan"), float("inf")


def test_nan_is_missing_everywhere(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (NAN, "c"), (None, "d")], "x double, s string")
    assert sorted(r.x for r in prepare.impute_median(df).collect()) == [1.0, 2.0, 2.0, 3.0]
    row = profile.reference_stats(df, ["x"]).first()
    assert (row["mean"], row["median"], row["q25"], row["q75"], row["min"], row["max"]) == (2.0, 2.0, 1.5, 2.5, 1.0, 3.0)
    row = profile.dataset_profile(df).where("column = 'x'").first()
    assert (row["null_count"], row["mean"], row["max"]) == (2, 2.0, 3.0)


@pytest.mark.parametrize("limit", [0, 3, 10_000])
def test_quantiles_with_infinities_do_not_depend_on_the_size(spark, limit):
    df = spark.createDataFrame([(x,) for x in (-INF, 1.0, 2.0, 2.0, 5.0, INF, INF, NAN, None)], "x double")
    assert ordering.exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.75, 1.0], exact_limit=limit)["x"] == [-INF, 1.5, 2.0, INF, INF]


def test_many_values_pass_through_brackets(spark):
    df = spark.range(150_000).select(((F.col("id") * 7919) % 150_000).cast("double").alias("x")).repartition(4)
    assert ordering.exact_quantiles(df, ["x"], [0.25, 0.5])["x"] == [37499.75, 74999.5]


def test_latency_covers_the_whole_log(spark):
    log = spark.range(30_000).select(F.col("id").alias("request_id"), F.timestamp_seconds("id").alias("ts"), F.lit("get").alias("method"),
                                     F.lit("/").alias("endpoint"), (F.col("id") / 1000).alias("duration"))
    row = traffic.latency_summary(log).first()
    assert (row.samples, row.p95_ms, row.p99_ms, row.min_ms) == (30_000, 28_500.0, 29_700.0, 0.0)


def test_all_predictions_can_match(spark):
    log = spark.range(2000).select(F.col("id").alias("prediction_id"), F.timestamp_seconds("id").alias("ts"), F.lit(1).alias("prediction"))
    feedback = spark.range(2000).select(F.col("id").alias("prediction_id"), F.lit(1).alias("actual_outcome"))
    assert predictions.join_feedback(feedback, log).where("was_correct").count() == 2000


def test_history_filters_before_it_counts(spark):
    log = spark.range(3000).select("id", F.timestamp_seconds("id").alias("ts"), F.lit("custom").alias("alert_type"),
                                   F.when(F.col("id") < 200, "error").otherwise("info").alias("severity"))
    assert alerts.alert_history(log, "ts", "id", severity="error").count() == 100


def test_tail_keeps_rows_without_a_time(spark):
    df = spark.sql("SELECT 1 AS id, timestamp'2024-01-02' AS ts UNION ALL SELECT 2, NULL UNION ALL SELECT 3, timestamp'2024-01-01'")
    assert [r.id for r in ordering.tail_rows(df, 5, "ts", "id").collect()] == [1, 3, 2]
    assert [r.id for r in ordering.tail_rows(df, 2, "ts", "id").collect()] == [1, 3]


def test_severity_uses_the_exact_score(spark):
    rows = spark.range(100_000).select((F.col("id") < 79_996).cast("int").alias("prediction"))
    found = alerts.alerts_from_drift(
        spark.createDataFrame([], "features_analyzed long, features_with_drift long, drift_ratio double, drift_detected boolean"),
        drift.prediction_drift(rows), F.current_timestamp()).first()
    assert found.severity == "warning" and found.metadata["drift_score"] == "0.3" and found.metadata["expected_share"] == "0.5"


def test_job_reports_an_odd_class_share_and_the_drifted_features(spark):
    log = spark.range(200).select(F.col("id").alias("prediction_id"), F.timestamp_seconds("id").alias("ts"), F.lit(1).alias("prediction"),
                                  (F.col("id") + 1000.0).alias("a"), (F.col("id") % 2).cast("double").alias("b"))
    reference = spark.createDataFrame([("a", 0.0, 1.0), ("b", 0.5, 1.0)], "feature string, mean double, std double")
    result = monitoring_job(log, reference, ["a", "b"])
    rows = {r.title: r for r in result.alerts.collect()}
    assert rows[alerts.CLASS_SHARE_TITLE].metadata["class_1_count"] == "200" and rows[alerts.CLASS_SHARE_TITLE].severity == "warning"
    assert rows[alerts.DATA_DRIFT_TITLE].metadata["features"] == "a"


def test_versions_without_runs_keep_their_number_and_stage(spark):
    known = spark.createDataFrame([("m", "1", "Production", "r1"), ("m", "2", "Staging", None), ("n", "1", "None", None), ("n", "2", "None", None)],
                                  "name string, version string, stage string, run_id string")
    log = spark.createDataFrame([("r1", {"f1": 0.5})], "run_id string, metrics map<string,double>")
    pairs = spark.createDataFrame([("m", "1", "2"), ("n", "1", "2")], "name string, version1 string, version2 string")
    rows = {r.name: r for r in runs.compare_versions(pairs, known, log).collect()}
    assert (rows["m"].entry, rows["m"].version2, rows["m"].stage2, rows["m"].value2) == ("f1", "2", "Staging", None)
    assert (rows["n"].entry, rows["n"].version1, rows["n"].version2) == (None, "1", "2")


def test_serving_tables_without_features_or_with_maps(spark, base):
    store = ServingStore(spark, f"{base}/serving")
    df = spark.createDataFrame([(1, {"a": 1.0}), (2, {"b": 2.0})], "id long, m map<string,double>")
    assert store.materialize(df, "maps", "id") == 2
    assert store.materialize_group(df, "alone", "id", ["absent"]) == 2
    assert Counter(r.id for r in store.get_features("alone", [1, 2]).collect()) == Counter([1, 2])


def test_tags_beyond_latin(spark):
    texts = ["tiếng", "ﬁnal", "Índice", "ｗｉｄｅ", "㎏", "é", "ok", None, "漢"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(scalars.normalize_tag(F.col("t"))).collect()] == \
        ["tieng", "final", "indice", "wide", "kg", "e", "ok", "", ""]
