import datetime as dt

import pytest
from pyspark.sql import functions as F

from featurelake.operators import traffic
from featurelake.operators.profile import column_moments
from featurelake.session import scratch_path
from featurelake.streaming import streams

SCHEMA = "id long, ts timestamp_ntz, method string, endpoint string, status int, duration double"
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def log(spark):
    """A log of several files, written in order of time."""
    path = scratch_path(spark, "log")
    for part in range(3):
        rows = [(i, START + dt.timedelta(seconds=20 * i), "get", "/p", 500 if i % 9 == 0 else 200, (i % 40) / 100)
                for i in range(part * 100, part * 100 + 100)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    return streams.stream_log(spark, path + "/", SCHEMA, "ts", files_per_batch=1)


@pytest.mark.parametrize("op", [traffic.request_rate, traffic.error_ratio, traffic.latency_quantiles])
def test_stream_equals_batch_up_to_the_watermark(spark, log, op):
    got = streams.drain_to_table(op(stream(spark, log)), "w").collect()
    batch = op(spark.read.parquet(log).withColumn("ts", F.col("ts").cast("timestamp")))
    closed = START + dt.timedelta(seconds=20 * 299) - dt.timedelta(minutes=10)
    want = batch.where(F.col("window_end") <= F.lit(closed)).collect()
    assert sorted(got) == sorted(want) and len(want) > 80


def test_counters_over_several_batches(spark, log):
    keys = ["status"]
    got = streams.drain_counters(streams.running_counts(stream(spark, log), keys, {"slow": F.count_if(F.col("duration") > 0.3)}),
                                 keys, "c")
    want = spark.read.parquet(log).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("duration") > 0.3).alias("slow"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_ingest_continues_where_it_stopped(spark, log):
    sink, state = scratch_path(spark, "sink"), scratch_path(spark, "state")

    def run():
        streams.start_append(stream(spark, log), sink, state).awaitTermination()
        return spark.read.parquet(sink).count()

    assert run() == 300
    spark.createDataFrame([(999, START, "get", "/p", 200, 0.1)], SCHEMA).write.mode("append").parquet(log)
    assert run() == 301


def test_feedback_join(spark):
    preds, answers = scratch_path(spark, "p"), scratch_path(spark, "f")
    at = lambda m: START + dt.timedelta(minutes=m)
    spark.createDataFrame([(1, at(0), 1), (2, at(1), 0), (3, at(500), 1)], "prediction_id long, ts timestamp, prediction int").write.parquet(preds)
    spark.createDataFrame([(1, at(5), 1), (2, at(200), 0), (7, at(6), 1), (3, at(501), 0)],
                          "prediction_id long, feedback_ts timestamp, actual_outcome int").write.parquet(answers)
    p = streams.stream_log(spark, preds + "/", "prediction_id long, ts timestamp, prediction int", "ts")
    f = streams.stream_log(spark, answers + "/", "prediction_id long, feedback_ts timestamp, actual_outcome int", "feedback_ts")
    out = streams.drain_to_table(streams.join_feedback_streams(p, f, "60 MINUTES"), "j")
    assert {r.prediction_id: (r.prediction, r.was_correct) for r in out.collect()} == {
        1: (1, True), 2: (None, None), 7: (None, None), 3: (1, False)}


def test_drift_batches_are_repeatable(spark):
    ref = column_moments(spark.createDataFrame([(float(i),) for i in range(10)], "x double"))
    feats, alerts = scratch_path(spark, "df"), scratch_path(spark, "da")
    check = streams.drift_batch(ref, ["x"], feats, alerts)
    batch = spark.createDataFrame([(100.0, 1)] * 5, "x double, prediction int")
    check(batch, 0)
    check(batch, 0)
    check(batch, 1)
    assert spark.read.parquet(feats).count() == 2
    assert spark.read.parquet(alerts).groupBy("batch_id").count().collect()[0]["count"] == 2
    with pytest.raises(ValueError):
        streams.drift_batch(None, ["x"], feats, alerts)


def test_late_rows(spark):
    df = spark.createDataFrame([(1, START), (2, START - dt.timedelta(hours=168)), (3, START - dt.timedelta(hours=169))],
                               "id int, ts timestamp")
    assert sorted(r.id for r in streams.drop_late(df, "ts", now=F.lit(START)).collect()) == [1, 2]
    assert streams.drop_late(df, "ts").count() == 0


def test_log_search_on_a_stream(spark):
    path = scratch_path(spark, "lines")
    rows = [("api", '{"event": "hit", "n": 3}'), ("api", "plain"), ("api", "{broken"), ("other", '{"event": "x"}')]
    spark.createDataFrame(rows, "service string, body string").write.parquet(path)
    lines = spark.readStream.schema("service string, body string").parquet(path)
    out = streams.drain_to_table(streams.search_logs(lines, "api", ["event", "n"]), "s").collect()
    assert sorted((r.event or "", r.n or "") for r in out) == [("", ""), ("", ""), ("hit", "3")]


def test_json_log_stream(spark):
    path = scratch_path(spark, "json")
    spark.createDataFrame([(1, "2024-01-01 00:00:00")], "id int, ts string").write.json(path)
    out = streams.drain_to_table(streams.stream_log(spark, path, "id int, ts timestamp_ntz", "ts", "json"), "j")
    assert out.first().ts == START
