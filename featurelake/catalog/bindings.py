"""How the roles of the operators map onto the given tables.

Every binding exists twice: as a DataFrame and as the body of a SQL common table expression, written
independently of each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Queries of one area by key, with their oracle where SQL can express them."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, key: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.queries[key] = fn
            if sql is not None:
                self.oracles[key] = sql
            return fn

        return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- wide, year-suffixed entity table --------------------------------------------------------------

YEARS = ["1998", "1999", "2000"]


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per customer with one spend, count and tier column per year."""
    year = F.year("o_orderdate")
    aggs = []
    for y in YEARS:
        hit = year == int(y)
        aggs += [
            F.round(F.sum(F.when(hit, F.col("o_totalprice"))), 2).alias(f"SPEND_{y}"),
            F.nullif(F.count_if(hit), F.lit(0)).cast("double").alias(f"NORD_{y}"),
            F.max(F.when(hit, F.col("o_orderpriority"))).alias(f"TIER_{y}"),
        ]
    grouped = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("customer_id")).agg(*aggs)
    return grouped.withColumn("NOME", F.concat(F.lit("C"), F.col("customer_id").cast("string")))


WIDE = """
  SELECT o_custkey AS customer_id, 'C' || o_custkey AS NOME, {cols}
  FROM orders GROUP BY o_custkey
""".format(cols=", ".join(f"""
    round(sum(CASE WHEN year(o_orderdate) = {y} THEN o_totalprice END), 2) AS SPEND_{y},
    CAST(nullif(count(CASE WHEN year(o_orderdate) = {y} THEN 1 END), 0) AS DOUBLE) AS NORD_{y},
    max(CASE WHEN year(o_orderdate) = {y} THEN o_orderpriority END) AS TIER_{y}""" for y in YEARS))


# -- long entity-year table ------------------------------------------------------------------------


def entity_years(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(
        F.col("o_custkey").alias("customer_id"), F.year("o_orderdate").alias("year")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("spend"), F.count(F.lit(1)).cast("double").alias("nord"))


ENTITY_YEARS = """
  SELECT o_custkey AS customer_id, CAST(year(o_orderdate) AS INTEGER) AS year,
         round(sum(o_totalprice), 2) AS spend, CAST(count(*) AS DOUBLE) AS nord
  FROM orders GROUP BY o_custkey, year(o_orderdate)
"""


# -- entity features -------------------------------------------------------------------------------


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with nation and order aggregates; negative balances count as missing, one segment
    has no name, and customers without orders have no spend."""
    spend = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.round(F.sum("o_totalprice"), 2).alias("spend"), F.count(F.lit(1)).alias("n_orders"))
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf, "customer")
    return (
        c.join(nation, c["c_nationkey"] == nation["n_nationkey"], "left")
        .join(spend, c["c_custkey"] == spend["o_custkey"], "left")
        .select(F.col("c_custkey").alias("customer_id"), "c_nationkey",
                F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("acctbal"), "spend", "n_orders",
                F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("segment"),
                F.col("n_name").alias("nation"))
    )


ENTITIES = """
  SELECT c_custkey AS customer_id, c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS acctbal,
         spend, n_orders, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS segment, n_name AS nation
  FROM customer
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS spend, count(*) AS n_orders
             FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey
"""


# -- reference and current frames ------------------------------------------------------------------

CUT = "1999-01-01"
DRIFT_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def reference_frame(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where(F.col("l_shipdate") < F.lit(CUT).cast("timestamp_ntz")).select(
        *DRIFT_COLUMNS)


def current_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Later rows; their quantity is shifted so that one feature drifts."""
    later = table(spark, sf, "lineitem").where(F.col("l_shipdate") >= F.lit(CUT).cast("timestamp_ntz"))
    return later.select((F.col("l_quantity") + 100).alias("l_quantity"), *DRIFT_COLUMNS[1:])


REFERENCE = f"""
  SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUT}'
"""
CURRENT = f"""
  SELECT l_quantity + 100 AS l_quantity, l_extendedprice, l_discount, l_tax
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '{CUT}'
"""


# -- logs ------------------------------------------------------------------------------------------


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as scored records: purchases are class 1."""
    return predictions_of(table(spark, sf, "events"))


def predictions_of(events: DataFrame) -> DataFrame:
    one = F.col("event_type") == "purchase"
    return events.select(
        F.col("event_id").alias("prediction_id"), "ts", one.cast("int").alias("prediction"),
        F.when(one, "likely").otherwise("unlikely").alias("label"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"), "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"))


PREDICTIONS = """
  SELECT event_id AS prediction_id, ts, CAST(event_type = 'purchase' AS INTEGER) AS prediction,
         CASE WHEN event_type = 'purchase' THEN 'likely' ELSE 'unlikely' END AS label,
         least(value / 100, 1.0::DOUBLE) AS confidence, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events
"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Events as requests: errors answer 500, slow ones have no method, fast ones a negative time."""
    return requests_of(table(spark, sf, "events"))


def requests_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("request_id"), "ts", F.col("event_type").alias("endpoint"),
        F.when(F.col("value") < 50, "get").when(F.col("value") < 200, "post").alias("method"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        ((F.col("value") - 1) / 1000).alias("duration"))


REQUESTS = """
  SELECT event_id AS request_id, ts, event_type AS endpoint,
         CASE WHEN value < 50 THEN 'get' WHEN value < 200 THEN 'post' END AS method,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, (value - 1) / 1000 AS duration
  FROM events
"""


def document_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as scored records: long ones are class 1, the score grows with the length."""
    n = F.col("n_chars").cast("double")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("prediction_id"), F.col("doc_id").alias("ts"),
        (n > 500).cast("int").alias("prediction"), (n / (n + 500)).alias("score"))


DOCUMENT_PREDICTIONS = """
  SELECT doc_id AS prediction_id, doc_id AS ts, CAST(n_chars > 500 AS INTEGER) AS prediction,
         CAST(n_chars AS DOUBLE) / (CAST(n_chars AS DOUBLE) + 500) AS score
  FROM documents
"""


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Quality labels as outcomes of document predictions."""
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("prediction_id"), F.col("quality").alias("actual_outcome"))


FEEDBACK = "SELECT doc_id AS prediction_id, quality AS actual_outcome FROM labels"


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Raw log bodies: errors log plain text, all others JSON."""
    return table(spark, sf, "events").select(
        "event_id", "ts", F.when(F.col("value") < 100, "scoring").alias("service"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("failed: "), "event_type"))
        .otherwise(F.col("props")).alias("body"), "event_type", "value")


LOG_LINES = """
  SELECT event_id, ts, CASE WHEN value < 100 THEN 'scoring' END AS service,
         CASE WHEN event_type = 'error' THEN 'failed: ' || event_type ELSE props END AS body, event_type, value
  FROM events
"""


# -- run log, versions, jobs, registry, alerts -----------------------------------------------------


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as training runs of one experiment per priority."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("experiment"),
        F.col("o_orderdate").alias("start_time"),
        F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "RUNNING")
        .otherwise("FINISHED").alias("status"),
        F.create_map(F.lit("owner"), F.col("o_custkey").cast("string")).alias("params"),
        F.create_map(F.lit("f1_score"), F.col("o_totalprice")).alias("metrics"))


RUNS = """
  SELECT o_orderkey AS run_id, o_orderpriority AS experiment, o_orderdate AS start_time,
         CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'RUNNING' ELSE 'FINISHED' END AS status,
         CAST(o_custkey AS VARCHAR) AS owner, o_totalprice AS f1_score
  FROM orders
"""


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as model versions: the brand is the model, the part key its version and run."""
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("name"), F.col("p_partkey").cast("string").alias("version"),
        F.col("p_partkey").alias("run_id"),
        F.when(size < 10, "Archived").when(size < 25, "Staging").when(size < 40, "Production")
        .otherwise("None").alias("stage"))


VERSIONS = """
  SELECT p_brand AS name, CAST(p_partkey AS VARCHAR) AS version, p_partkey AS run_id,
         CASE WHEN p_size < 10 THEN 'Archived' WHEN p_size < 25 THEN 'Staging'
              WHEN p_size < 40 THEN 'Production' ELSE 'None' END AS stage
  FROM part
"""


def job_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as job runs, one job per priority; failed orders are failed runs."""
    failed = F.col("o_orderstatus") == "F"
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("job"), F.col("o_orderdate").alias("ts"),
        ((F.col("o_totalprice") - 50000) / 1000).alias("duration"), (~failed).alias("success"),
        failed.cast("int").alias("exit_code"), "o_totalprice")


JOB_RUNS = """
  SELECT o_orderkey AS run_id, o_orderpriority AS job, o_orderdate AS ts, (o_totalprice - 50000) / 1000 AS duration,
         o_orderstatus <> 'F' AS success, CAST(o_orderstatus = 'F' AS INTEGER) AS exit_code, o_totalprice
  FROM orders
"""


def feature_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as feature definitions; the words of the name are accented, mixed-case tags."""
    p = table(spark, sf, "part")
    return p.select(
        F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"),
        F.when(F.col("p_size") < 25, "numeric").otherwise("categorical").alias("dtype"),
        F.col("p_type").alias("description"), F.concat_ws("_", "p_type", F.col("p_partkey").cast("string")).alias("source"),
        F.when(F.col("p_size") < 25, "standard_scaling").otherwise("label_encoding").alias("transformation"),
        F.lit("1.0.0").alias("version"),
        F.transform(F.split("p_name", " "), lambda t: F.concat(F.lit(" "), F.upper(F.replace(t, F.lit("e"), F.lit("é")))))
        .alias("tags"))


def feature_members(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as group members: a brand-like group per ship mode of the supplier. Members
    above the part count have no definition."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderpriority").alias("group_name"), F.lit("customer").alias("entity"),
        F.col("o_orderkey").cast("int").alias("position"),
        F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("feature"))


FEATURES = """
  SELECT 'f' || p_partkey AS name, CASE WHEN p_size < 25 THEN 'numeric' ELSE 'categorical' END AS dtype,
         p_type AS description, p_type || '_' || p_partkey AS source, p_name,
         CASE WHEN p_size < 25 THEN 'standard_scaling' ELSE 'label_encoding' END AS transformation
  FROM part
"""
MEMBERS = """
  SELECT o_orderpriority AS group_name, CAST(o_orderkey AS INTEGER) AS position, 'f' || o_custkey AS feature
  FROM orders
"""


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as past alerts."""
    value = F.col("value")
    kind = (
        F.when(F.col("event_type") == "view", "data_drift").when(F.col("event_type") == "click", "prediction_drift")
        .when(F.col("event_type") == "purchase", "model_performance")
        .when(F.col("event_type") == "signup", "training_complete").otherwise("api_error"))
    severity = F.when(value < 20, "info").when(value < 60, "warning").when(value < 150, "error").otherwise("critical")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("alert_id"), "ts", kind.alias("alert_type"), severity.alias("severity"), "value")


ALERTS = """
  SELECT event_id AS alert_id, ts,
         CASE event_type WHEN 'view' THEN 'data_drift' WHEN 'click' THEN 'prediction_drift'
              WHEN 'purchase' THEN 'model_performance' WHEN 'signup' THEN 'training_complete' ELSE 'api_error'
         END AS alert_type,
         CASE WHEN value < 20 THEN 'info' WHEN value < 60 THEN 'warning' WHEN value < 150 THEN 'error'
              ELSE 'critical' END AS severity, value
  FROM events
"""
