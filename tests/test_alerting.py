import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from featurelake.operators import alerts, drift, runs
from featurelake.operators.profile import column_moments
from featurelake.session import scratch_path
from featurelake.streaming import alerting, streams

START = dt.datetime(2024, 1, 1)


def states_by_step(values, hold, until):
    """Every step from the first to the last one looked at, with what it finds: True, False or nothing."""
    out, since, firing = [], None, False
    for step in range(min(values), until + 1):
        if step not in values:
            if since is not None:
                out.append((step, since, None, "resolved" if firing else "inactive"))
            since, firing = None, False
        elif values[step]:
            since = step if since is None else since
            firing = step - since >= hold
            out.append((step, since, True, "firing" if firing else "pending"))
        else:
            out.append((step, None, False, "resolved" if firing else "inactive"))
            since, firing = None, False
    return out


@pytest.mark.parametrize("hold", [0, 1, 3])
def test_runs_equal_a_walk_over_every_step(hold):
    rng = random.Random(hold)
    for _ in range(200):
        values = {s: rng.random() < 0.8 for s in sorted(rng.sample(range(40), rng.randint(1, 30)))}
        until = max(values) + rng.randint(0, 5)
        cuts = sorted(rng.sample(range(until + 1), min(3, until + 1))) + [until]
        run, rows, done = None, [], -1
        for cut in cuts:
            run, found = alerting.advance(run, [(s * 10, v) for s, v in values.items() if done < s <= cut], hold, 10, cut * 10)
            rows, done = rows + found, cut
        got = [(at // 10, None if since is None else since // 10, held, state) for at, since, held, state in rows]
        assert got == states_by_step(values, hold, until)


def test_late_rows_and_a_restart(spark, base):
    """Rows within the delay are put in order, rows behind the watermark change nothing, and a new query goes on with the state."""
    log, sink, state = f"{base}/log", f"{base}/sink", f"{base}/state"
    schema = "rule string, host int, at timestamp_ntz, bad boolean"

    def put(rows):
        spark.createDataFrame([(r, h, START + dt.timedelta(minutes=m), b) for r, h, m, b in rows], schema).coalesce(1).write.mode("append").parquet(log)

    def run():
        stream = streams.stream_log(spark, f"{log}/", schema, "at", delay="2 minutes", files_per_batch=1)
        rows = alerting.alert_states(stream, "at", F.col("bad"), {"slow": 3, "down": 1, "other": 1}, keys=("rule", "host"))
        alerting.start_alerts(rows, sink, state).awaitTermination()
        return {(r.rule, r.host, int((r["at"] - START).total_seconds() // 60)): (r.held, r.state) for r in spark.read.parquet(sink).collect()}

    values = {("slow", 1): {m: m > 1 for m in range(12)}, ("slow", 2): {m: m % 5 > 0 for m in range(12)}, ("down", 1): {m: m != 6 for m in range(12)}}
    rows = [(*key, m, b) for key, own in values.items() for m, b in own.items()]
    put([r for r in rows if r[2] <= 5 and r[2] != 4])
    put([r for r in rows if r[2] in (6, 7, 4)])  # 4 comes late, but within the delay
    first = run()
    assert ("slow", 1, 5) in first and ("slow", 1, 7) not in first
    put([("slow", 1, 0, True), ("slow", 1, 1, True)])  # behind the watermark
    put([r for r in rows if r[2] > 7])
    put([("other", 9, 30, False)])
    got = run()
    want = {}
    for key, own in values.items():
        want.update({(*key, s): (held, state) for s, _, held, state in states_by_step(own, {"slow": 3, "down": 1}[key[0]], 28)})
    assert {k: v for k, v in got.items() if k[0] != "other"} == want


def test_drift_by_period_equals_single_summaries(spark):
    rng = random.Random(2)
    rows = [(d, rng.gauss(d, 1), rng.choice([None, float("nan"), 1.0, 5.0 * d])) for d in range(4) for _ in range(50)]
    df = spark.createDataFrame(rows, "d int, x double, y double")
    reference = column_moments(df.where("d < 2").select("x", "y"))
    got = {r.d: r for r in drift.drift_by_period(reference, df, "d", ["x", "y"], 0.8).collect()}
    for d in range(4):
        want = drift.drift_summary(drift.drift_features(reference, df.where(F.col("d") == d).select("x", "y"), 0.8)).first()
        assert (got[d].features_analyzed, got[d].features_with_drift, got[d].drift_ratio, got[d].drift_detected) == tuple(want) and got[d].n == 50
    report = drift.drift_report(spark.createDataFrame([(1, 2, 2)], "t int, n int, features_analyzed int"), "t", "n", features=["x", "y"]).first()
    assert report.reference_features == ["x", "y"] and report.drift_threshold == 0.1


def test_details_of_versions_without_extra_fields(spark):
    versions = spark.createDataFrame([("m", "1", 7, "None"), ("m", "2", 8, "Staging")], "name string, version string, run_id int, stage string")
    pointers = spark.createDataFrame([("m", "1", "Production")], "name string, version string, stage string")
    rows = {r.version: r for r in runs.version_details(versions, pointers).collect()}
    assert rows["1"].stage == "Production" and rows["2"].stage == "Staging"
    assert rows["1"].tags == {} and rows["1"].status is None and len(rows["1"]) == 10


def test_promotion_alert_carries_metrics(spark):
    df = spark.createDataFrame([("m", 3, 0.5)], "model string, version int, f1 double")
    row = df.select(alerts.promotion_alert(F.col("model"), F.col("version"), F.lit("Production"), F.current_timestamp(), {"f1_score": F.col("f1")}).alias("a")).first().a
    assert row.metadata == {"model_name": "m", "version": "3", "stage": "Production", "f1_score": "0.5"}
