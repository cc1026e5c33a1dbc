"""Queries on training runs, model versions and scheduled jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurelake.catalog.bindings import JOB_RUNS, RUNS, VERSIONS, Catalog, job_runs, runs, table, versions
from featurelake.functions import scalars
from featurelake.operators import alerts as alerting
from featurelake.operators import runs as runlog
from featurelake.operators import traffic
from featurelake.session import scratch_path

catalog = Catalog()
PREFIX = "featurelake_"


@catalog.add("runs_recent", f"""
WITH r AS ({RUNS}) SELECT run_id, experiment, start_time, status FROM r ORDER BY start_time DESC, run_id DESC LIMIT 100""")
def _(spark, sf):
    return runlog.recent_runs(runs(spark, sf)).select("run_id", "experiment", "start_time", "status")


@catalog.add("runs_best", f"""
WITH r AS ({RUNS}) SELECT run_id, start_time, f1_score AS value FROM r
ORDER BY f1_score DESC, start_time DESC, run_id DESC LIMIT 1""")
def _(spark, sf):
    return runlog.best_run(runs(spark, sf), "f1_score").select("run_id", "start_time", "value")


_BEST_PER_EXPERIMENT = """
  SELECT run_id FROM (SELECT run_id, row_number() OVER (PARTITION BY experiment
         ORDER BY f1_score, start_time DESC, run_id DESC) AS i FROM r) WHERE i = 1"""


@catalog.add("runs_compare", f"""
WITH r AS ({RUNS}), best AS ({_BEST_PER_EXPERIMENT})
SELECT run_id, status, start_time, 'params' AS kind, 'owner' AS entry, CAST(owner AS DOUBLE) AS value
FROM r WHERE run_id IN (SELECT run_id FROM best)
UNION ALL SELECT run_id, status, start_time, 'metrics', 'f1_score', f1_score
FROM r WHERE run_id IN (SELECT run_id FROM best)""")
def _(spark, sf):
    log = runs(spark, sf)
    lowest = runlog.best_run(log, "f1_score", ascending=True, keys=["experiment"]).select("run_id")
    return runlog.compare_runs(log, lowest).withColumn("value", F.col("value").cast("double"))


@catalog.add("versions_latest_per_stage", f"""
WITH v AS ({VERSIONS})
SELECT name, stage, CAST(max(CAST(version AS BIGINT)) AS VARCHAR) AS version, max(run_id) AS run_id
FROM v GROUP BY name, stage""")
def _(spark, sf):
    return runlog.latest_per_stage(versions(spark, sf))


_POINTERS = """
  SELECT p_brand AS name, CAST(min(p_partkey) AS VARCHAR) AS version, 'Production' AS stage
  FROM part WHERE p_size >= 40 GROUP BY p_brand"""


def _pointers(spark, sf):
    return table(spark, sf, "part").where("p_size >= 40").groupBy(F.col("p_brand").alias("name")).agg(
        F.min("p_partkey").cast("string").alias("version")).withColumn("stage", F.lit("Production"))


@catalog.add("versions_detail", f"""
WITH v AS ({VERSIONS}), p AS ({_POINTERS})
SELECT v.name, v.version, v.run_id, CASE WHEN v.stage <> 'None' THEN v.stage ELSE coalesce(p.stage, 'None') END AS stage
FROM v LEFT JOIN p ON p.name = v.name AND p.version = v.version""")
def _(spark, sf):
    return runlog.version_details(versions(spark, sf), _pointers(spark, sf)).select("name", "version", "run_id", "stage")


@catalog.add("versions_detail_full", f"""
WITH v AS (SELECT v.*, p.p_name, p.p_type, o.o_orderdate FROM ({VERSIONS}) v JOIN part p ON p.p_partkey = v.run_id
           LEFT JOIN orders o ON o.o_orderkey = v.run_id), p AS ({_POINTERS})
SELECT v.name, v.version, CASE WHEN v.stage <> 'None' THEN v.stage ELSE coalesce(p.stage, 'None') END AS stage, 'READY' AS status,
       'runs/' || v.run_id || '/model' AS source, v.run_id, o_orderdate AS creation_timestamp,
       o_orderdate + INTERVAL 1 HOUR AS last_updated_timestamp, p_name AS description, CAST(v.stage = 'None' AS INTEGER) AS n_tags,
       CASE WHEN v.stage = 'None' THEN p_type END AS kind
FROM v LEFT JOIN p ON p.name = v.name AND p.version = v.version""")
def _(spark, sf):
    """All ten fields of every version; parts without a stage carry a tag, the others none."""
    described = table(spark, sf, "part").select(F.col("p_partkey").alias("run_id"), F.col("p_name").alias("description"), "p_type")
    made = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("creation_timestamp"))
    known = versions(spark, sf).join(described, "run_id").join(made, "run_id", "left").withColumns({
        "status": F.lit("READY"), "source": F.concat(F.lit("runs/"), "run_id", F.lit("/model")),
        "last_updated_timestamp": F.col("creation_timestamp") + F.make_dt_interval(hours=F.lit(1)),
        "tags": F.when(F.col("stage") == "None", F.create_map(F.lit("kind"), F.col("p_type")))})
    return runlog.version_details(known, _pointers(spark, sf)).withColumns({
        "n_tags": F.size("tags"), "kind": F.try_element_at("tags", F.lit("kind"))}).drop("tags")


@catalog.add("promotion_alerts", f"""
WITH v AS ({VERSIONS}), r AS ({RUNS})
SELECT 'model_promoted' AS alert_type, 'info' AS severity, 'Model Promoted: ' || v.name AS title,
       v.name || ' version ' || v.version || ' is now in Production' AS message, v.name AS model_name, v.version, 'Production' AS stage,
       round(f1_score, 2) AS f1_score
FROM v LEFT JOIN r USING (run_id) WHERE v.stage = 'Production'""")
def _(spark, sf):
    """One alert per promoted version, with the metrics of its run."""
    promoted = versions(spark, sf).where("stage = 'Production'").join(runs(spark, sf).select("run_id", "metrics"), "run_id", "left")
    row = alerting.promotion_alert(F.col("name"), F.col("version"), F.col("stage"), F.current_timestamp(), {
        "f1_score": F.try_element_at("metrics", F.lit("f1_score"))})
    meta = F.col("a.metadata")
    return promoted.select(row.alias("a")).select(
        "a.alert_type", "a.severity", "a.title", "a.message", meta["model_name"].alias("model_name"), meta["version"].alias("version"),
        meta["stage"].alias("stage"), F.round(meta["f1_score"].cast("double"), 2).alias("f1_score"))


_STATUS = """
  SELECT name, count(*) AS total_versions,
         max(CASE WHEN stage = 'Production' THEN CAST(version AS BIGINT) END) AS production_version,
         max(CASE WHEN stage = 'Staging' THEN CAST(version AS BIGINT) END) AS staging_version
  FROM v GROUP BY name"""


@catalog.add("versions_status", f"WITH v AS ({VERSIONS}) {_STATUS}")
def _(spark, sf):
    return runlog.registry_status(versions(spark, sf))


@catalog.add("versions_compare", f"""
WITH v AS ({VERSIONS}), r AS ({RUNS}), s AS ({_STATUS}),
e AS (SELECT run_id, 'params' AS kind, 'owner' AS entry, CAST(owner AS DOUBLE) AS value FROM r
      UNION ALL SELECT run_id, 'metrics', 'f1_score', f1_score FROM r)
SELECT s.name, a.kind, a.entry, CAST(s.production_version AS VARCHAR) AS version1,
       CAST(s.staging_version AS VARCHAR) AS version2, 'Production' AS stage1, 'Staging' AS stage2,
       a.value AS value1, b.value AS value2
FROM s JOIN e a ON a.run_id = s.production_version JOIN e b ON b.run_id = s.staging_version AND a.entry = b.entry""")
def _(spark, sf):
    known = versions(spark, sf)
    pairs = runlog.registry_status(known).where("production_version IS NOT NULL AND staging_version IS NOT NULL").select(
        "name", F.col("production_version").cast("string").alias("version1"),
        F.col("staging_version").cast("string").alias("version2"))
    return runlog.compare_versions(pairs, known, runs(spark, sf)).withColumns({
        "value1": F.col("value1").cast("double"), "value2": F.col("value2").cast("double")})


# -- jobs ------------------------------------------------------------------------------------------


def _records(spark, sf):
    raw = job_runs(spark, sf)
    return traffic.job_run_records(raw, PREFIX, {"last price": F.col("o_totalprice")})


@catalog.add("job_run_metrics", f"""
WITH j AS ({JOB_RUNS})
SELECT job, ts AS last_run, greatest(duration, 0) AS last_duration, CAST(success AS INTEGER) AS last_success,
       exit_code AS last_exit_code, o_totalprice AS price FROM j""")
def _(spark, sf):
    path = scratch_path(spark, "job-runs")
    _records(spark, sf).write.mode("append").parquet(path)
    back = spark.read.parquet(path)
    return back.select("job", "last_run", "last_duration", "last_success", "last_exit_code",
                       F.col("metrics")[f"{PREFIX}last_price"].alias("price"))


def _expected(spark):
    jobs = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "never"]
    ages = [traffic.MAX_AGE_SECONDS["training"], traffic.MAX_AGE_SECONDS["monitoring"]]
    return spark.createDataFrame([(j, ages[i % 2]) for i, j in enumerate(jobs)], "job string, max_age_seconds long")


@catalog.add("job_staleness", f"""
WITH j AS ({JOB_RUNS}), l AS (SELECT job, max(ts) AS last_run FROM j WHERE success GROUP BY job),
x AS (SELECT * FROM (VALUES ('1-URGENT', 691200), ('2-HIGH', 28800), ('3-MEDIUM', 691200), ('4-NOT SPECIFIED', 28800),
                            ('5-LOW', 691200), ('never', 28800)) AS t(job, max_age)),
now AS (SELECT max(o_orderdate) + INTERVAL 7 DAY AS t FROM orders)
SELECT x.job, last_run, CAST(date_diff('second', last_run, t) AS BIGINT) AS age_seconds,
       last_run IS NULL OR date_diff('second', last_run, t) > max_age AS stale
FROM x LEFT JOIN l USING (job), now""")
def _(spark, sf):
    records = _records(spark, sf)
    now = table(spark, sf, "orders").agg(
        F.max("o_orderdate") + F.make_dt_interval(days=F.lit(7))).first()[0]
    return traffic.stale_jobs(records.where("last_success = 1"), _expected(spark), now)


@catalog.add("job_last_failed", f"""
WITH j AS ({JOB_RUNS}), l AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts DESC, run_id DESC) AS i FROM j)
SELECT job, CAST(success AS INTEGER) AS last_success, greatest(duration, 0) AS last_duration,
       NOT success AS failed FROM l WHERE i = 1""")
def _(spark, sf):
    raw = job_runs(spark, sf)
    records = raw.select("run_id", "job", F.col("ts").alias("last_run"),
                         F.greatest("duration", F.lit(0.0)).alias("last_duration"),
                         F.col("success").cast("int").alias("last_success"))
    return traffic.failed_jobs(records)


@catalog.add("metric_name_sanitize", """
WITH t AS (SELECT p_partkey, CASE WHEN p_size < 10 THEN '  ' WHEN p_size < 20 THEN '9 (' || p_name || ')'
                                  WHEN p_size < 30 THEN 'featurelake_' || p_type ELSE p_name || ' (%)' END AS raw FROM part),
n AS (SELECT p_partkey, raw, regexp_replace(trim(raw), '[^a-zA-Z0-9_:]', '_', 'g') AS body FROM t)
SELECT p_partkey, CASE WHEN body = '' THEN 'featurelake_job_metric' WHEN starts_with(body, 'featurelake_') THEN body
                       ELSE 'featurelake_' || body END AS metric,
       replace(replace(replace(raw, ' ', '_'), '(', ''), ')', '') AS feature FROM n""")
def _(spark, sf):
    size, name = F.col("p_size"), F.col("p_name")
    raw = (F.when(size < 10, "  ").when(size < 20, F.concat(F.lit("9 ("), name, F.lit(")")))
           .when(size < 30, F.concat(F.lit(PREFIX), "p_type")).otherwise(F.concat(name, F.lit(" (%)"))))
    return table(spark, sf, "part").select("p_partkey", scalars.metric_name(raw, PREFIX).alias("metric"),
                                           scalars.feature_metric_name(raw).alias("feature"))


@catalog.add("truncate_text", "SELECT doc_id, left(text, 500) AS text, length(text) > 500 AS cut FROM documents")
def _(spark, sf):
    """Long messages as alerts carry them."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", scalars.truncate_text(F.col("text")).alias("text"), (F.length("text") > 500).alias("cut"))


@catalog.add("truthy_switches", """
WITH t AS (SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'Yes' WHEN 2 THEN 'y' WHEN 3 THEN 'on' WHEN 4 THEN '1'
                                             WHEN 5 THEN 'off' WHEN 6 THEN '' END AS switch FROM part)
SELECT p_partkey, coalesce(lower(trim(switch)) IN ('1', 'true', 'yes', 'y', 'on'), false) AS plain,
       coalesce(lower(trim(switch)) IN ('1', 'true', 'yes', 'y', 'on'), true) AS on_by_default FROM t""")
def _(spark, sf):
    texts = [" TRUE ", "Yes", "y", "on", "1", "off", "", None]
    switch = F.element_at(F.array(*[F.lit(t) for t in texts]), F.col("p_size") % 8 + 1)
    return table(spark, sf, "part").select("p_partkey", scalars.truthy(switch).alias("plain"), scalars.truthy(switch, True).alias("on_by_default"))
