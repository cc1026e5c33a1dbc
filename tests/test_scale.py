"""Plans and skew: what must hold on data far larger than the fixtures."""

import pytest
from pyspark.sql import functions as F

from featurelake.catalog import bindings
from featurelake.functions.ordering import tail_rows
from featurelake.operators import drift, evaluate, features, predictions, split, traffic
from featurelake.operators.profile import column_moments
from featurelake.session import shared_root


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_statistics_read_only_their_columns_and_push_filters(spark, sf):
    text = plan(column_moments(bindings.reference_frame(spark, sf)))
    assert text.count("FileScan") == 1
    assert "l_shipdate" in text.split("PushedFilters")[1].split("\n")[0]
    assert "l_returnflag" not in text


def test_drift_scans_each_side_once(spark, sf):
    out = drift.drift_features(column_moments(bindings.reference_frame(spark, sf)), bindings.current_frame(spark, sf))
    assert plan(out).count("FileScan") == 2


def test_tail_filters_the_scan(spark, sf):
    text = plan(tail_rows(bindings.table(spark, sf, "events"), 20, "ts", "event_id"))
    assert "TakeOrderedAndProject" in text and "GreaterThanOrEqual(ts" in text


def test_no_query_windows_all_rows_in_one_task(spark, sf):
    heavy = {
        "rolling": predictions.rolling_class_ratio(bindings.predictions(spark, sf)),
        "sustained": traffic.sustained(traffic.error_ratio(bindings.requests(spark, sf)).select("window_end", "alert"),
                                       "window_end", "alert", 10),
        "split": split.stratified_split(bindings.table(spark, sf, "orders"), "o_orderstatus", "o_orderkey"),
        "auc": evaluate.roc_auc(bindings.document_predictions(spark, sf).withColumn("label", F.col("prediction"))),
    }
    for name, df in heavy.items():
        for line in plan(df).splitlines():
            if "Window [" in line:
                partitioned = line.rsplit("], [", 1)
                # Unpartitioned windows may only run over per-partition totals.
                assert len(partitioned) == 2 or "__part" in line, (name, line)


def test_no_query_has_a_nested_loop_or_cartesian_join(spark, sf):
    import __spark_entry__ as entry

    for key in ("label_encode_unseen", "recent_window_summary", "monitoring_check", "drift_report", "class_weights",
                "reference_stats", "stratified_split", "feature_transform"):
        text = plan(entry.queries()[key](spark, sf))
        assert "NestedLoop" not in text and "Cartesian" not in text, key


def test_large_dictionary_is_joined_without_broadcast(spark):
    rows = spark.range(3000).select("id", F.col("id").cast("string").alias("c"))
    dictionary = features.fit_dictionary(rows, ["c"])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = features.apply_dictionary(rows, dictionary, ["c"])
        assert not [x for x in plan(out).splitlines() if "BroadcastHashJoin" in x and "LeftOuter" in x]
        assert out.where("c_encoded < 0").count() == 0 and out.count() == 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_hot_values_change_nothing(spark):
    """A third of all rows share one key, one score and one second."""
    n = 3000
    df = spark.range(n).select(
        F.col("id").alias("prediction_id"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(1)).alias("score"),
        (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 2).cast("int").alias("prediction"),
        F.timestamp_seconds(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))).alias("ts"))
    pdf = df.toPandas()
    ordered = pdf.sort_values(["ts", "prediction_id"])["prediction"].tolist()
    got = predictions.rolling_class_ratio(df, width=500).orderBy("idx").collect()
    assert [r.class_1_ratio for r in got] == [round(sum(ordered[i - 50:i]) / 50, 4) for i in range(50, n)]
    ranks = pdf["score"].rank()
    pos = pdf["label"] == 1
    want = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert evaluate.roc_auc(df).first().roc_auc == pytest.approx(want, abs=1e-4)


def test_shared_folder_comes_from_the_session(spark):
    assert shared_root(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())


def test_no_local_checkpoint_or_cross_join_in_the_library():
    import pathlib

    for path in pathlib.Path(__file__).parent.parent.joinpath("featurelake").rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text and "crossJoin" not in text and "toPandas" not in text, path


def test_splits_label_rows_in_one_scan_of_the_input(spark, sf):
    import __spark_entry__ as entry

    text = plan(entry.queries()["stratified_folds"](spark, sf))
    assert text.count("lineitem.parquet") == 1 and "Union" not in text and "Window" not in text
