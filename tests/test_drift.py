import random

import pytest
from pyspark.sql import functions as F

from featurelake.operators import alerts, drift
from featurelake.operators.profile import column_moments, dataset_profile, reference_stats
from featurelake.plans.monitoring import monitoring_job


def frame(spark, means, n, seed=42):
    rng = random.Random(seed)
    rows = [tuple(rng.gauss(m, s) for m, s in means) for _ in range(n)]
    return spark.createDataFrame(rows, "feature_1 double, feature_2 double, feature_3 double")


@pytest.fixture(scope="module")
def reference(spark):
    return column_moments(frame(spark, [(10, 2), (5, 1), (0, 0.5)], 100))


def test_same_laws_do_not_drift(spark, reference):
    out = drift.drift_features(reference, frame(spark, [(10, 2), (5, 1), (0, 0.5)], 50, 7))
    assert out.where("drift").count() == 0 and out.count() == 3
    assert not drift.drift_summary(out).first().drift_detected


def test_shifted_means_drift(spark, reference):
    row = drift.drift_summary(drift.drift_features(reference, frame(spark, [(20, 2), (15, 1), (5, 0.5)], 50))).first()
    assert row.drift_detected and row.drift_ratio == 1.0 and row.features_with_drift == 3


@pytest.mark.parametrize("values", [[1.0, 1.0, 1.0], [1.0]])
def test_no_spread_scores_zero(spark, values):
    ref = column_moments(spark.createDataFrame([(v,) for v in values], "x double"))
    row = drift.drift_features(ref, spark.createDataFrame([(2.0,)] * 3, "x double")).first()
    assert row.z_score == 0.0 and not row.drift


def test_nan_current_mean_is_no_drift(spark):
    ref = column_moments(spark.createDataFrame([(1.0,), (2.0,)], "x double"))
    row = drift.drift_features(ref, spark.createDataFrame([(float("nan"),)], "x double")).first()
    assert row.z_score == 0.0 and row.drift is False


def test_no_shared_numeric_column(spark, reference):
    out = drift.drift_features(reference, spark.createDataFrame([("a",)], "s string"))
    row = drift.drift_summary(out).first()
    assert (row.features_analyzed, row.drift_ratio, row.drift_detected) == (0, None, False)


def test_prediction_drift(spark):
    balanced = spark.createDataFrame([(i % 2,) for i in range(100)], "prediction int")
    assert drift.prediction_drift(balanced).first().drift_score == 0.0
    skewed = spark.createDataFrame([(int(i >= 10),) for i in range(100)], "prediction int")
    row = drift.prediction_drift(skewed).first()
    assert row.drift_score == 0.4 and row.drift_detected
    assert not drift.prediction_drift(skewed, expected=0.9).first().drift_detected
    assert drift.prediction_drift(skewed.limit(0)).count() == 0


def test_class_ratio_is_not_judged_without_predictions(spark):
    row = drift.class_ratio_bounds(spark.createDataFrame([], "prediction int")).first()
    assert row.total == 0 and row.out_of_bounds is None
    ones = spark.createDataFrame([(1,)] * 5, "prediction int")
    assert drift.class_ratio_bounds(ones).first().out_of_bounds


def test_reference_stats_are_linear_quantiles(spark):
    df = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 10)], "x double")
    row = reference_stats(df).first()
    assert (row.q25, row["median"], row.q75, row.mean) == (1.75, 2.5, 4.75, 4.0)


def test_profile_of_an_all_null_column(spark):
    df = spark.createDataFrame([(None, "a", 1), (None, None, 2)], "x double, s string, i int")
    out = {r["column"]: r for r in dataset_profile(df).collect()}
    assert out["x"].null_pct == 100.0 and out["x"].mean is None and out["x"].unique_count is None
    assert out["s"].unique_count == 1 and out["i"].std == 0.7071 and out["i"].num_rows == 2


@pytest.mark.parametrize("ratio,severity", [(0.49, "warning"), (0.5, "error")])
def test_data_drift_severity(spark, ratio, severity):
    summary = spark.createDataFrame([(10, 3, ratio, True)],
                                    "features_analyzed long, features_with_drift long, drift_ratio double, drift_detected boolean")
    none = spark.createDataFrame([], "sample_size long, class_0_share double, class_1_share double, drift_score double, drift_detected boolean")
    row = alerts.alerts_from_drift(summary, none, F.current_timestamp()).first()
    assert row.severity == severity and row.alert_type == "data_drift" and "3 of 10" in row.message


@pytest.mark.parametrize("score,severity", [(0.29, "warning"), (0.3, "error")])
def test_prediction_drift_severity(spark, score, severity):
    none = spark.createDataFrame([], "features_analyzed long, features_with_drift long, drift_ratio double, drift_detected boolean")
    pred = spark.createDataFrame([(5, 0.2, 0.8, score, True)],
                                 "sample_size long, class_0_share double, class_1_share double, drift_score double, drift_detected boolean")
    row = alerts.alerts_from_drift(none, pred, F.current_timestamp()).first()
    assert row.severity == severity and row.metadata["sample_size"] == "5"


def test_alert_types_and_severities_are_checked():
    with pytest.raises(ValueError):
        alerts.alert("nonsense", "info", "t", F.lit("m"), {}, F.current_timestamp())
    with pytest.raises(ValueError):
        alerts.alert("custom", "loud", "t", F.lit("m"), {}, F.current_timestamp())


def test_typed_alerts(spark):
    now, one = F.current_timestamp(), spark.range(1)
    rows = {
        "api_error": alerts.api_error_alert(F.lit("/p"), F.repeat(F.lit("x"), 900), F.lit(500), now),
        "training_failed": alerts.training_failed_alert(F.lit("m"), F.repeat(F.lit("x"), 900), now),
        "model_performance": alerts.performance_alert(F.lit("f1"), F.lit(0.5), F.lit(0.8), now),
        "model_promoted": alerts.promotion_alert(F.lit("m"), F.lit(3), F.lit("Production"), now),
        "training_complete": alerts.training_complete_alert(F.lit("m"), F.lit(12.34), {"f1": F.lit(0.91)}, now),
    }
    got = {k: one.select(v.alias("a")).select("a.*").first() for k, v in rows.items()}
    assert all(r.alert_type == k for k, r in got.items())
    assert len(got["api_error"].metadata["error"]) == 500 and len(got["training_failed"].metadata["error"]) == 500
    assert got["model_performance"].metadata["difference"] == "0.3"
    assert got["training_complete"].metadata["metric_f1"] == "0.91"
    feature = spark.createDataFrame([("x", 2.5)], "feature string, z_score double")
    assert feature.select(alerts.feature_drift_alert(now, 2.0).alias("a")).first().a.metadata["exceeded_by"] == "0.5"


def test_history_keeps_the_newest(spark):
    log = spark.createDataFrame([(i, i, "custom", "info") for i in range(3)], "ts int, id int, alert_type string, severity string")
    assert [r.id for r in alerts.alert_history(log, "ts", "id", kept=2).collect()] == [2, 1]
    assert alerts.alert_history(log, "ts", "id", severity="error").count() == 0


def test_monitoring_job(spark, reference):
    rows = frame(spark, [(20, 2), (15, 1), (5, 0.5)], 40).withColumn("prediction_id", F.monotonically_increasing_id())
    log = rows.withColumns({"ts": F.timestamp_seconds(F.col("prediction_id") % 1000), "prediction": F.lit(1)})
    result = monitoring_job(log, reference, ["feature_1", "feature_2", "feature_3"], window=30, fail_on_alert=True)
    row = result.summary.first()
    assert row.window_size == 30 and row.data_drift and row.prediction_drift and row.out_of_bounds
    assert row.has_alert and row.retrain and row.exit_code == 1 and row.all_predictions == 40
    assert result.features.count() == 3 and result.alerts.count() == 3  # data, predictions, class share
    calm = monitoring_job(log.limit(0), reference, ["feature_1"]).summary
    assert calm.count() == 0
