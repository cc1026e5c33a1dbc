"""Queries on versioned data sets, serving tables, the feature registry and the JSON logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurelake.catalog.bindings import (ENTITIES, FEATURES, FEEDBACK, MEMBERS, PREDICTIONS, REFERENCE, Catalog,
                                          entities, feature_definitions, feature_members, feedback, predictions,
                                          reference_frame, table)
from featurelake.operators.profile import reference_stats
from featurelake.operators.rollups import day_statistics, rolled_up_stats, statistics_state
from featurelake.operators.validate import consistency_check, consistency_full, key_intersection, sample_rows
from featurelake.session import scratch_path
from featurelake.sources import logs
from featurelake.sources.offline import OfflineStore
from featurelake.sources.registry import FEATURE_SCHEMA, MEMBER_SCHEMA, FeatureRegistry
from featurelake.sources.serving import MATERIALIZED_AT, ServingStore
from featurelake.sources.status import store_status

catalog = Catalog()
COLUMNS = ["customer_id", "c_nationkey", "acctbal", "spend", "n_orders", "segment", "nation"]
_ALL = f"WITH e AS ({ENTITIES}) SELECT {', '.join(COLUMNS)} FROM e"


def _offline(spark):
    return OfflineStore(spark, scratch_path(spark, "offline"))


def _serving(spark):
    return ServingStore(spark, scratch_path(spark, "serving"))


# -- offline ---------------------------------------------------------------------------------------


@catalog.add("offline_ingest_roundtrip", _ALL)
def _(spark, sf):
    store = _offline(spark)
    store.ingest(entities(spark, sf), "customers", "customer_id", version="v1")
    return store.get_dataset("customers", "v1")


@catalog.add("offline_get_filtered", f"""
WITH e AS ({ENTITIES}) SELECT customer_id, acctbal FROM e
WHERE segment IN ('BUILDING', 'FURNITURE') AND nation = 'NATION_3'""")
def _(spark, sf):
    store = _offline(spark)
    store.ingest(entities(spark, sf), "customers", "customer_id")
    return store.get_dataset("customers", columns=["customer_id", "acctbal"], filters={
        "segment": ["BUILDING", "FURNITURE"], "nation": "NATION_3", "no_such_column": 1})


def _three_versions(spark, sf):
    store = _offline(spark)
    rows = table(spark, sf, "customer")
    store.ingest(rows, "customers", "c_custkey", version="9")
    store.ingest(rows.where("c_acctbal > 0"), "customers", "c_custkey", version="10")
    store.ingest(table(spark, sf, "orders"), "orders", "o_orderkey", "o_orderdate", version="1")
    return store


_V9 = "SELECT 'customers' AS dataset, '9' AS version, count(*) AS num_rows, 5 AS num_columns FROM customer"
_V10 = """SELECT 'customers' AS dataset, '10' AS version, count(*) AS num_rows, 5 AS num_columns FROM customer
          WHERE c_acctbal > 0"""
_O1 = "SELECT 'orders' AS dataset, '1' AS version, count(*) AS num_rows, 6 AS num_columns FROM orders"


@catalog.add("offline_versions", f"{_V9} UNION ALL {_V10} UNION ALL {_O1}")
def _(spark, sf):
    return _three_versions(spark, sf).manifest().select("dataset", "version", "num_rows", "num_columns")


@catalog.add("offline_latest_version", f"""
SELECT dataset, version, num_rows FROM ({_V10}) UNION ALL SELECT dataset, version, num_rows FROM ({_O1})""")
def _(spark, sf):
    return _three_versions(spark, sf).latest_versions().select("dataset", "version", "num_rows")


@catalog.add("offline_after_delete", f"{_V9} UNION ALL {_O1}")
def _(spark, sf):
    store = _three_versions(spark, sf)
    store.delete_version("customers", "10")
    return store.manifest().select("dataset", "version", "num_rows", "num_columns")


# -- serving ---------------------------------------------------------------------------------------


@catalog.add("serving_materialize", f"WITH e AS ({ENTITIES}) SELECT customer_id, acctbal, segment FROM e")
def _(spark, sf):
    store = _serving(spark)
    store.materialize(entities(spark, sf), "features", "customer_id")
    store.materialize(entities(spark, sf), "features", "customer_id", ["acctbal", "segment"])
    return store.table("features").drop(MATERIALIZED_AT)


@catalog.add("serving_table_info", """
SELECT 'features' AS table_name, 'customer_id' AS entity_column, 'acctbal,segment' AS feature_columns,
       count(*) AS num_rows FROM customer""")
def _(spark, sf):
    store = _serving(spark)
    store.materialize(entities(spark, sf), "features", "customer_id", ["acctbal", "segment"])
    store.materialize(entities(spark, sf), "dropped", "customer_id", ["acctbal"])
    store.delete_table("dropped")
    return store.catalog().select("table_name", "entity_column", F.concat_ws(",", "feature_columns").alias(
        "feature_columns"), "num_rows")


@catalog.add("sync_offline_to_serving", _ALL)
def _(spark, sf):
    offline, serving = _offline(spark), _serving(spark)
    offline.ingest(entities(spark, sf), "customers", "customer_id", version="v1")
    serving.sync_from(offline, "customers", "features", "customer_id")
    return serving.table("features").drop(MATERIALIZED_AT)


def _wanted(spark, sf):
    """Customers with an urgent order, repeated per order, and as many absent ids."""
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return urgent.select(F.col("o_custkey").alias("id")).unionByName(urgent.select((-F.col("o_custkey") - 1).alias("id")))


@catalog.add("serving_lookup", f"""
WITH e AS ({ENTITIES}) SELECT customer_id, spend, segment FROM e
WHERE customer_id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def _(spark, sf):
    store = _serving(spark)
    store.materialize(entities(spark, sf), "features", "customer_id")
    return store.get_features("features", _wanted(spark, sf), ["spend", "segment"])


@catalog.add("serving_vector", f"WITH e AS ({ENTITIES}) SELECT {', '.join(COLUMNS)} FROM e WHERE customer_id = 7")
def _(spark, sf):
    store = _serving(spark)
    store.materialize(entities(spark, sf), "features", "customer_id")
    found = store.get_features("features", [7]).drop(MATERIALIZED_AT)
    return found.orderBy(*found.columns).limit(1)


@catalog.add("access_log_append", """
SELECT 'features' AS table_name, CAST(id AS VARCHAR) AS entity_id, count(*) AS n FROM (
  SELECT o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT -o_custkey - 1 FROM orders WHERE o_orderpriority = '1-URGENT')
GROUP BY id""")
def _(spark, sf):
    store = _serving(spark)
    store.materialize(entities(spark, sf), "features", "customer_id", ["spend"])
    store.get_features("features", _wanted(spark, sf))
    return store.access_log().groupBy("table_name", "entity_id").agg(F.count(F.lit(1)).alias("n"))


def _two_sides(spark, sf):
    """Entities, and a served copy that lacks one nation, has other balances for a second and no spend for a third."""
    rows = entities(spark, sf).select("customer_id", "acctbal", "spend", "segment", "nation")
    served = rows.where("nation <> 'NATION_5'").withColumns({
        "acctbal": F.when(F.col("nation") == "NATION_3", -1.0).otherwise(F.col("acctbal")),
        "spend": F.when(F.col("nation") != "NATION_4", F.col("spend"))}).drop("nation")
    return rows.drop("nation"), served


@catalog.add("consistency_check", f"""
WITH e AS ({ENTITIES}), s AS (
  SELECT customer_id, CASE WHEN nation = 'NATION_3' THEN -1 ELSE acctbal END AS acctbal,
         segment, CASE WHEN nation = 'NATION_4' THEN NULL ELSE spend END AS spend FROM e WHERE nation <> 'NATION_5'),
j AS (SELECT count(*) AS compared_rows,
             count(*) FILTER (WHERE e.acctbal IS DISTINCT FROM s.acctbal) AS acctbal,
             count(*) FILTER (WHERE e.spend IS DISTINCT FROM s.spend) AS spend,
             count(*) FILTER (WHERE e.segment IS DISTINCT FROM s.segment) AS segment
      FROM e JOIN s USING (customer_id))
SELECT compared_rows, false AS is_consistent, 'acctbal' AS "column", acctbal AS mismatches FROM j
UNION ALL SELECT compared_rows, false, 'spend', spend FROM j
UNION ALL SELECT compared_rows, false, 'segment', segment FROM j""")
def _(spark, sf):
    rows, served = _two_sides(spark, sf)
    return consistency_check(rows, served, "customer_id", sample_size=None)


@catalog.add("consistency_full", f"""
WITH e AS ({ENTITIES}), s AS (
  SELECT customer_id, CASE WHEN nation = 'NATION_3' THEN -1 ELSE acctbal END AS acctbal,
         segment, CASE WHEN nation = 'NATION_4' THEN NULL ELSE spend END AS spend FROM e WHERE nation <> 'NATION_5')
SELECT e.customer_id, CASE WHEN s.customer_id IS NULL THEN 'offline_only' ELSE 'different' END AS status,
       CASE WHEN s.customer_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN e.acctbal IS DISTINCT FROM s.acctbal THEN 'acctbal' END,
            CASE WHEN e.spend IS DISTINCT FROM s.spend THEN 'spend' END) END AS columns
FROM e LEFT JOIN s USING (customer_id)
WHERE s.customer_id IS NULL OR e.acctbal IS DISTINCT FROM s.acctbal OR e.spend IS DISTINCT FROM s.spend""")
def _(spark, sf):
    """Every planted difference of the whole tables, with its columns."""
    found = consistency_full(*_two_sides(spark, sf), "customer_id")
    return found.withColumn("columns", F.concat_ws(",", "columns"))


@catalog.add("deterministic_sample", """
SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(o_orderkey || '-42'), o_orderkey LIMIT 100""")
def _(spark, sf):
    return sample_rows(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100)


@catalog.add("key_intersection", """
SELECT c_custkey AS customer_id FROM customer INTERSECT SELECT o_custkey FROM orders""")
def _(spark, sf):
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"))
    return key_intersection(left, table(spark, sf, "orders").select(F.col("o_custkey").alias("customer_id")),
                            "customer_id")


# -- registry --------------------------------------------------------------------------------------


def _registry(spark, sf):
    return FeatureRegistry(feature_definitions(spark, sf), feature_members(spark, sf))


def _value_registry(spark):
    """Small group over the entity table: one member has no definition."""
    features = [("balance", "numeric", None, "acctbal", "standard_scaling", "1.0.0", ["money"]),
                ("spend", "numeric", None, "spend", "standard_scaling", "1.0.0", ["money"]),
                ("points", "numeric", None, "points", "standard_scaling", "1.0.0", ["money"])]
    members = [("value", "customer", 0, "spend"), ("value", "customer", 1, "balance"),
               ("value", "customer", 2, "undefined"), ("wide", "customer", 0, "points"), ("wide", "customer", 1, "spend")]
    return FeatureRegistry(spark.createDataFrame(features, FEATURE_SCHEMA), spark.createDataFrame(members, MEMBER_SCHEMA))


@catalog.add("registry_group_members", f"""
WITH f AS ({FEATURES}), m AS ({MEMBERS})
SELECT group_name, position, feature, dtype, source FROM m JOIN f ON f.name = m.feature""")
def _(spark, sf):
    return _registry(spark, sf).group_features().select("group_name", "position", "feature", "dtype", "source")


@catalog.add("registry_by_tag", f"""
WITH f AS ({FEATURES}) SELECT name, source FROM f WHERE list_contains(string_split(p_name, ' '), 'red')""")
def _(spark, sf):
    return _registry(spark, sf).features_by_tag("  RÉD").select("name", "source")


@catalog.add("registry_listing", f"""
WITH f AS ({FEATURES})
SELECT name, dtype, CASE WHEN dtype = 'categorical' THEN 'replaced' ELSE source END AS source FROM f
UNION ALL SELECT 'fresh_' || name, 'numeric', 'replaced' FROM f WHERE dtype = 'categorical'""")
def _(spark, sf):
    registry = _registry(spark, sf)
    changed = registry.features.where("dtype = 'categorical'").withColumn("source", F.lit("replaced"))
    fresh = changed.withColumns({"name": F.concat(F.lit("fresh_"), "name"), "dtype": F.lit("numeric")})
    return registry.register_features(changed.unionByName(fresh)).list_features().select("name", "dtype", "source")


@catalog.add("registry_groups", f"""
WITH m AS ({MEMBERS}) SELECT group_name, 'customer' AS entity, count(*) AS members FROM m GROUP BY group_name""")
def _(spark, sf):
    return _registry(spark, sf).list_groups()


@catalog.add("group_projection", f"WITH e AS ({ENTITIES}) SELECT spend, acctbal FROM e")
def _(spark, sf):
    return _value_registry(spark).project(entities(spark, sf), "value")


@catalog.add("serving_materialize_group", f"WITH e AS ({ENTITIES}) SELECT customer_id, spend FROM e")
def _(spark, sf):
    store = _serving(spark)
    columns = _value_registry(spark).source_columns("wide")
    store.materialize_group(entities(spark, sf), "features", "customer_id", columns)
    return store.table("features").drop(MATERIALIZED_AT)


@catalog.add("training_pair", f"WITH e AS ({ENTITIES}) SELECT spend, acctbal, n_orders FROM e")
def _(spark, sf):
    store = _offline(spark)
    store.ingest(entities(spark, sf), "customers", "customer_id")
    return store.get_training_pair("customers", _value_registry(spark).source_columns("value"), "n_orders")


@catalog.add("store_status", """
SELECT 'features' AS item, CAST(NULL AS VARCHAR) AS name, count(*) AS n FROM part
UNION ALL SELECT 'groups', NULL, count(DISTINCT o_orderpriority) FROM orders
UNION ALL SELECT 'dataset', 'customers', 2
UNION ALL SELECT 'dataset', 'orders', 1
UNION ALL SELECT 'table', 'features', count(*) FROM customer""")
def _(spark, sf):
    serving = _serving(spark)
    serving.materialize(entities(spark, sf), "features", "customer_id", ["spend"])
    return store_status(_registry(spark, sf), _three_versions(spark, sf), serving)


# -- logs ------------------------------------------------------------------------------------------


def _scored(spark, sf):
    p = predictions(spark, sf)
    return p.select(
        F.col("prediction_id").cast("string").alias("prediction_id"), F.col("ts").alias("timestamp"), "prediction",
        "label", "confidence", F.lit("m1").alias("model_version"), "value", "k")


def _prediction_log(spark, sf):
    path = scratch_path(spark, "predictions")
    logs.append_log(logs.prediction_records(_scored(spark, sf), ["value", "k"]), path)
    return path


_LOG_COLUMNS = """prediction_id, prediction, label, round(confidence, 4) AS confidence, round(value, 4) AS value,
                  round(k, 4) AS k, 'm1' AS model_version"""


def _flat(log):
    number = lambda name: F.round(F.col("input")[name].cast("double"), 4).alias(name)
    return log.select(
        F.col("output.prediction_id").cast("bigint").alias("prediction_id"), "output.prediction", "output.label",
        F.round("output.confidence", 4).alias("confidence"), number("value"), number("k"), "model_version")


@catalog.add("predlog_roundtrip", f"WITH p AS ({PREDICTIONS}) SELECT {_LOG_COLUMNS} FROM p")
def _(spark, sf):
    return _flat(logs.read_log(spark, _prediction_log(spark, sf), logs.PREDICTION_SCHEMA))


@catalog.add("predlog_last_n", f"""
WITH p AS ({PREDICTIONS}) SELECT {_LOG_COLUMNS} FROM p ORDER BY ts DESC, prediction_id DESC LIMIT 1000""")
def _(spark, sf):
    return _flat(logs.recent_predictions(spark, _prediction_log(spark, sf), 1000))


@catalog.add("json_extract", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       coalesce(json_extract_string(props, '$.label'), event_type) AS label FROM events""")
def _(spark, sf):
    parsed = F.from_json("props", "k int, label string")
    return table(spark, sf, "events").select(
        "event_id", parsed["k"].alias("k"), F.coalesce(parsed["label"], "event_type").alias("label"))


@catalog.add("feedback_roundtrip", f"""
WITH f AS ({FEEDBACK}) SELECT CAST(prediction_id AS VARCHAR) AS prediction_id, actual_outcome,
                              actual_outcome = 1 AS was_correct FROM f""")
def _(spark, sf):
    path = scratch_path(spark, "feedback")
    rows = feedback(spark, sf).withColumns({
        "timestamp": F.lit("2024-01-01").cast("timestamp_ntz"), "was_correct": F.col("actual_outcome") == 1})
    logs.append_log(logs.feedback_records(rows), path)
    return logs.read_log(spark, path, logs.FEEDBACK_SCHEMA).select("prediction_id", "actual_outcome", "was_correct")


_STATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _stats_sql(source: str) -> str:
    return " UNION ALL ".join(f"""
SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min,
       round(max({c}), 4) AS max, round(quantile_cont({c}, 0.25), 4) AS q25, round(median({c}), 4) AS median,
       round(quantile_cont({c}, 0.75), 4) AS q75 FROM {source}""" for c in _STATS)


def _rounded_stats(df):
    return df.select("feature", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max", "q25", "median", "q75")])


@catalog.add("reference_stats", _stats_sql("lineitem"))
def _(spark, sf):
    return _rounded_stats(reference_stats(table(spark, sf, "lineitem").select(*_STATS)))


@catalog.add("reference_stats_rollup", _stats_sql("lineitem"))
def _(spark, sf):
    """The same figures from states by day, written in two steps of which the second never reads the first one's days."""
    rows = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"), *_STATS)
    state = statistics_state(spark, scratch_path(spark, "statistics"))
    state.replace(day_statistics(rows.where("day < date '1998-01-01'")))
    state.replace(day_statistics(rows.where("day >= date '1998-01-01'")))
    return _rounded_stats(rolled_up_stats(state.read(), rows.select(*_STATS)))


@catalog.add("reference_snapshot", f"WITH r AS ({REFERENCE}) {_stats_sql('r')}")
def _(spark, sf):
    path = scratch_path(spark, "reference")
    logs.save_reference(reference_frame(spark, sf), path)
    return _rounded_stats(reference_stats(logs.load_reference(spark, path)))
