"""Queries on splits, training, evaluation, scoring and explanation."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from featurelake.catalog.bindings import (DOCUMENT_PREDICTIONS, ENTITIES, FEEDBACK, Catalog, document_predictions,
                                          entities, feedback, table)
from featurelake.operators.features import TARGET
from featurelake.functions.ordering import global_index
from featurelake.operators import evaluate as ev
from featurelake.operators import explain, score, split, train
from featurelake.plans.training import training_from_wide, training_job, with_entity_id
from featurelake.session import on_all_cores, scratch_path
from featurelake.sources.offline import OfflineStore
from featurelake.sources.serving import ServingStore

catalog = Catalog()

_KEY_PARTS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
INPUTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _line_id():
    parts = [F.col(c).cast("string") for c in _KEY_PARTS] + [F.to_date("l_shipdate").cast("string")]
    return F.concat_ws("-", *parts).alias("line_id")


def _lines(spark, sf):
    """Line items with a text key and a binary label: returned or not."""
    return table(spark, sf, "lineitem").select(
        _line_id(), *INPUTS, (F.col("l_returnflag") == "R").cast("double").alias("label"))


def _training(spark, sf):
    """Label that depends on the inputs, so that a model can learn it: expensive returns."""
    hit = (F.col("l_returnflag") == "R") | (F.col("l_extendedprice") > 50000) & (F.col("l_discount") < 0.05)
    return table(spark, sf, "lineitem").select(_line_id(), *INPUTS, hit.cast("double").alias("label"))


def _vectors(spark, sf):
    return VectorAssembler(inputCols=INPUTS, outputCol="features").transform(_training(spark, sf))


_LINES = """
  SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-'
         || CAST(l_shipdate AS DATE) AS line_id,
         CAST(l_returnflag = 'R' AS DOUBLE) AS label FROM lineitem"""
_RANKED = f"""
WITH t AS ({_LINES}),
r AS (SELECT line_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(line_id || '-42'), line_id) - 1 AS i,
             count(*) OVER (PARTITION BY label) AS n FROM t)"""


# -- order, split, folds, weights ------------------------------------------------------------------


@catalog.add("dense_entity_id", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS entity_id FROM orders""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return with_entity_id(rows, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "entity_id")


@catalog.add("stratified_split", f"""{_RANKED}
SELECT line_id, label, CASE WHEN i < CAST(round(n * 0.2::DOUBLE) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM r""")
def _(spark, sf):
    return split.stratified_split(_lines(spark, sf).select("line_id", "label"), "label", "line_id")


@catalog.add("stratified_folds", f"""{_RANKED}
SELECT line_id, CAST(i >= floor(n * 1 / 5) AS INTEGER) + CAST(i >= floor(n * 2 / 5) AS INTEGER)
       + CAST(i >= floor(n * 3 / 5) AS INTEGER) + CAST(i >= floor(n * 4 / 5) AS INTEGER) AS fold FROM r""")
def _(spark, sf):
    return split.stratified_folds(_lines(spark, sf).select("line_id", "label"), "label", "line_id").select(
        "line_id", "fold")


@catalog.add("split_summary", f"""{_RANKED},
s AS (SELECT label, CASE WHEN i < CAST(round(n * 0.2::DOUBLE) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM r)
SELECT split, count(*) AS n, round(avg(label), 3) AS positive_ratio FROM s GROUP BY split""")
def _(spark, sf):
    rows = split.stratified_split(_lines(spark, sf).select("line_id", "label"), "label", "line_id")
    return ev.split_summary(rows)


@catalog.add("class_weights", f"""
WITH t AS ({_LINES}), c AS (SELECT label, count(*) AS n FROM t GROUP BY label)
SELECT label, n, round(CAST((SELECT sum(n) FROM c) AS DOUBLE) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c""")
def _(spark, sf):
    return split.class_weights(_lines(spark, sf), "label").withColumn("weight", F.round("weight", 6))


# -- evaluation ------------------------------------------------------------------------------------

_JUDGED = f"""
WITH p AS ({DOCUMENT_PREDICTIONS}), f AS ({FEEDBACK}),
j AS (SELECT prediction, score, actual_outcome AS label FROM f JOIN p USING (prediction_id)),
c AS (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1)::DOUBLE AS tp,
             count(*) FILTER (WHERE label = 0 AND prediction = 1)::DOUBLE AS fp,
             count(*) FILTER (WHERE label = 1 AND prediction = 0)::DOUBLE AS fn,
             count(*) FILTER (WHERE label = 0 AND prediction = 0)::DOUBLE AS tn FROM j)"""


def _judged(spark, sf):
    return feedback(spark, sf).join(document_predictions(spark, sf), "prediction_id").withColumnRenamed(
        "actual_outcome", "label")


@catalog.add("confusion_matrix", f"""{_JUDGED}
SELECT y AS label, p AS prediction, count(label) AS n
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS g(y, p) LEFT JOIN j ON j.label = y AND j.prediction = p GROUP BY y, p""")
def _(spark, sf):
    return ev.confusion_matrix(_judged(spark, sf))


@catalog.add("binary_metrics", f"""{_JUDGED}
SELECT round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy,
       round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 4) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 4) AS recall,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 4) AS f1_score FROM c""")
def _(spark, sf):
    return ev.binary_metrics(_judged(spark, sf))


@catalog.add("roc_auc", f"""{_JUDGED},
k AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM j)
SELECT round((sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1)
              * (count(*) FILTER (WHERE label = 1) + 1) / 2.0::DOUBLE)
             / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)), 4) AS roc_auc FROM k""")
def _(spark, sf):
    return ev.roc_auc(_judged(spark, sf))


@catalog.add("roc_auc_by_group", """
WITH j AS (SELECT l_linestatus AS part, l_extendedprice AS score, CAST(l_returnflag = 'R' AS INTEGER) AS label
           FROM lineitem),
k AS (SELECT part, label, rank() OVER (PARTITION BY part ORDER BY score)
             + (count(*) OVER (PARTITION BY part, score) - 1) / 2.0::DOUBLE AS r FROM j)
SELECT part, round((sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1)
                    * (count(*) FILTER (WHERE label = 1) + 1) / 2.0::DOUBLE)
                   / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)), 4) AS roc_auc
FROM k GROUP BY part""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("part"), F.col("l_extendedprice").alias("score"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return ev.roc_auc(rows, keys=["part"])


def _report_row(name: str, p: str, r: str, f: str, support: str) -> str:
    return (f"SELECT '{name}' AS \"class\", round({p}, 4) AS precision, round({r}, 4) AS recall, "
            f"round({f}, 4) AS f1_score, CAST({support} AS BIGINT) AS support FROM m")


@catalog.add("classification_report", f"""{_JUDGED},
m AS (SELECT *, tp + fn AS n1, tn + fp AS n0, tp + fn + tn + fp AS n,
             coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1,
             coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
             coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0,
             coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f0 FROM c)
""" + " UNION ALL ".join([
    _report_row("0", "p0", "r0", "f0", "n0"), _report_row("1", "p1", "r1", "f1", "n1"),
    _report_row("accuracy", "(tp + tn) / n", "(tp + tn) / n", "(tp + tn) / n", "n"),
    _report_row("macro avg", "(p0 + p1) / 2", "(r0 + r1) / 2", "(f0 + f1) / 2", "n"),
    _report_row("weighted avg", "(p0 * n0 + p1 * n1) / n", "(r0 * n0 + r1 * n1) / n", "(f0 * n0 + f1 * n1) / n", "n")]))
def _(spark, sf):
    return ev.classification_report(_judged(spark, sf))


# -- fixed linear model ----------------------------------------------------------------------------

WEIGHTS = {"acctbal": 0.0004, "spend": -0.0000002, "n_orders": 0.05}
INTERCEPT = -1.25
_Z = "-1.25 + " + " + ".join(f"coalesce({c}, 0) * ({w:.10f}::DOUBLE)" for c, w in WEIGHTS.items())


@catalog.add("linear_score", f"""
WITH e AS ({ENTITIES}), s AS (SELECT customer_id, 1 / (1 + exp(-({_Z}))) AS p FROM e)
SELECT customer_id, CAST(p >= 0.5 AS INTEGER) AS prediction,
       CASE WHEN p >= 0.5 THEN 'Ponto de Virada Provável' ELSE 'Ponto de Virada Improvável' END AS label,
       round(1 - p, 4) AS probability_no_turning_point, round(p, 4) AS probability_turning_point, round(greatest(p, 1 - p), 4) AS confidence,
       'm1' AS model_version, 'file' AS loaded_from FROM s""")
def _(spark, sf):
    rows = entities(spark, sf)
    scored = rows.withColumn("p", score.linear_score(rows, WEIGHTS, INTERCEPT))
    columns = score.score_columns(F.col("p"), (F.col("p") >= 0.5).cast("int"), "m1", "file")
    return scored.withColumns(columns).select("customer_id", *columns)


_PARTS_SQL = " UNION ALL ".join(
    f"SELECT customer_id, '{c}' AS feature, round({w:.10f}::DOUBLE * (coalesce({c}, 0) - (SELECT avg(coalesce({c}, 0)) "
    f"FROM e)), 4) AS contribution FROM e" for c, w in WEIGHTS.items())


def _contributions(spark, sf, n):
    rows = entities(spark, sf)
    parts = explain.linear_contributions(rows, WEIGHTS, explain.feature_means(rows, list(WEIGHTS)))
    return rows.select("customer_id", explain.top_contributions(parts, n).alias("parts"))


@catalog.add("linear_contributions", f"""
WITH e AS ({ENTITIES}), c AS ({_PARTS_SQL})
SELECT customer_id, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY abs(contribution) DESC, feature) - 1
                         AS INTEGER) AS rank, feature, contribution FROM c""")
def _(spark, sf):
    return _contributions(spark, sf, None).select("customer_id", F.posexplode("parts").alias("rank", "part")).select(
        "customer_id", "rank", "part.*")


@catalog.add("topn_contributions", f"""
WITH e AS ({ENTITIES}), c AS ({_PARTS_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY abs(contribution) DESC, feature) AS i FROM c)
SELECT customer_id, feature, contribution FROM r WHERE i <= 2""")
def _(spark, sf):
    return _contributions(spark, sf, 2).select("customer_id", F.inline("parts"))


# -- trained models (checked by invariants) --------------------------------------------------------


def _importances(spark, sf, model_type, **overrides):
    model = train.train(_vectors(spark, sf), model_type, **overrides)
    return train.feature_importance(model, INPUTS)


@catalog.add("train_random_forest")
def _(spark, sf):
    return _importances(spark, sf, "random_forest")


@catalog.add("train_gbt")
def _(spark, sf):
    return _importances(spark, sf, "gradient_boosting")


@catalog.add("train_logreg")
def _(spark, sf):
    model = train.train(_vectors(spark, sf), "logistic_regression").stages[-1]
    rows = list(zip(INPUTS, [float(w) for w in model.coefficients]))
    return spark.createDataFrame(rows + [("intercept", float(model.intercept))], "feature string, weight double")


@catalog.add("feature_importance")
def _(spark, sf):
    return _importances(spark, sf, "random_forest")


@catalog.add("cross_validation")
def _(spark, sf):
    return train.cross_validate(_vectors(spark, sf), "logistic_regression", "line_id")


# -- what must hold for trained models -------------------------------------------------------------

_LEARNED = """
SELECT CAST(4 AS BIGINT) AS features, '{}' AS leading, 1.0::DOUBLE AS total, CAST(0 AS BIGINT) AS negative, true AS falling"""


def _learned(importances, leading=2):
    """The label depends on price and discount alone, so a forest that has learned it puts these two first, and boosting, which goes
    on to follow the noise, at least price; importances are shares."""
    by_size = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("i"), F.col("feature").alias("f")))), 1, leading)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("i"), F.col("at").alias("at"))))
    numbered = importances.withColumn("at", F.monotonically_increasing_id())  # four rows, in the operator's order
    return numbered.agg(
        F.count(F.lit(1)).alias("features"), F.array_join(F.array_sort(F.transform(by_size, lambda x: x["f"])), ",").alias("leading"),
        F.round(F.sum("importance"), 9).alias("total"),
        F.count_if(F.col("importance") < 0).alias("negative"), listed.alias("l")).withColumn(
        "falling", F.array_sort(F.transform("l", lambda x: x["at"])) == F.transform("l", lambda x: x["at"])).drop("l")


@catalog.add("train_random_forest_check", _LEARNED.format("l_discount,l_extendedprice"))
def _(spark, sf):
    return _learned(_importances(spark, sf, "random_forest"))


@catalog.add("train_gbt_check", _LEARNED.format("l_extendedprice"))
def _(spark, sf):
    return _learned(_importances(spark, sf, "gradient_boosting"), 1)


@catalog.add("feature_importance_check", _LEARNED.format("l_discount,l_extendedprice"))
def _(spark, sf):
    """The same for a model that was saved and loaded; names travel by position."""
    model = train.train(_vectors(spark, sf), "random_forest")
    return _learned(train.feature_importance(train.load_model(train.save_model(model, scratch_path(spark, "model"), "v1")), INPUTS))


@catalog.add("train_logreg_check", """
SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'intercept']) AS term, true AS settled FROM (SELECT count(*) FROM lineitem)""")
def _(spark, sf):
    """The derivatives of the penalised weighted loss cancel: each is below a thousandth of the terms it is the sum of."""
    rows = _vectors(spark, sf)
    gradient = train.logistic_gradient(train.train(rows, "logistic_regression"), rows, INPUTS)
    return gradient.select("term", (F.abs("gradient") < F.col("size") / 1000).alias("settled"))


@catalog.add("cross_validation_check", """
WITH t AS (SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || CAST(l_shipdate AS DATE) AS line_id,
                  CAST(l_returnflag = 'R' OR l_extendedprice > 50000 AND l_discount < 0.05 AS DOUBLE) AS label FROM lineitem),
r AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY md5(line_id || '-42'), line_id) - 1 AS i,
             count(*) OVER (PARTITION BY label) AS n FROM t),
f AS (SELECT label, CAST(i >= floor(n * 1 / 5) AS INTEGER) + CAST(i >= floor(n * 2 / 5) AS INTEGER)
             + CAST(i >= floor(n * 3 / 5) AS INTEGER) + CAST(i >= floor(n * 4 / 5) AS INTEGER) AS fold FROM r)
SELECT fold, count(*) AS n, count(*) AS entities, CAST(sum(label) AS BIGINT) AS positives, true AS same_accuracy, true AS better_than_chance
FROM f GROUP BY fold""")
def _(spark, sf):
    """Every row is held out once, in the fold that SQL counts for it; the summary's accuracy follows from the written rows."""
    held_out = train.held_out_scores(_vectors(spark, sf), "logistic_regression", "line_id")
    per_fold = held_out.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("line_id").alias("entities"), F.sum("label").cast("bigint").alias("positives"),
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))
    summary = {r["metric"]: r["mean"] for r in train.fold_summary(held_out).collect()}  # five rows
    recomputed = per_fold.agg(F.avg("accuracy")).first()[0]
    return per_fold.select("fold", "n", "entities", "positives", F.lit(abs(summary["accuracy"] - recomputed) < 0.0002).alias("same_accuracy"),
                           F.lit(summary["roc_auc"] > 0.6).alias("better_than_chance"))


@catalog.add("batch_score")
def _(spark, sf):
    rows = _vectors(spark, sf)
    model = train.train(rows, "random_forest")
    return score.score_batch(model, rows, "m1", key="line_id").select(
        "prediction_id", "prediction", "label", "probability_no_turning_point", "probability_turning_point", "confidence", "model_version")


def _scored_by_ids(spark, sf):
    rows = _vectors(spark, sf)
    model = train.train(rows, "random_forest")
    store = ServingStore(spark, scratch_path(spark, "serving"))
    store.materialize(rows.drop("label"), "lines", "line_id")
    wanted = table(spark, sf, "lineitem").where("l_quantity > 40").select(_line_id())
    return score.score_by_ids(model, store, "lines", wanted, "m1")


@catalog.add("score_by_ids")
def _(spark, sf):
    return _scored_by_ids(spark, sf).select("prediction_id", "prediction", "confidence")


@catalog.add("score_by_ids_check", f"""
WITH t AS ({_LINES} WHERE l_quantity > 40)
SELECT line_id AS prediction_id, 'm1' AS model_version, 'serving' AS loaded_from, true AS plausible FROM t""")
def _(spark, sf):
    """Exactly the wanted rows are scored, each with a confidence of at least one half."""
    return _scored_by_ids(spark, sf).select(
        "prediction_id", "model_version", "loaded_from", F.col("confidence").between(0.5, 1.0).alias("plausible"))


@catalog.add("model_roundtrip", "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM lineitem")
def _(spark, sf):
    rows = _vectors(spark, sf)
    model = train.train(rows, "random_forest")
    loaded = train.load_model(train.save_model(model, scratch_path(spark, "model"), "v1"))
    before = train.predict_rows(model, on_all_cores(rows)).select("line_id", F.col("score").alias("before"))
    after = train.predict_rows(loaded, on_all_cores(rows)).select("line_id", F.col("score").alias("after"))
    return before.join(after, "line_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("before") != F.col("after")).alias("changed"))


@catalog.add("tree_contributions")
def _(spark, sf):
    rows = _vectors(spark, sf)
    model = train.train(rows, "random_forest")
    path = train.save_model(model, scratch_path(spark, "model"), "v1")
    trees = explain.tree_nodes(spark, train.stage_path(path, model))
    parts = explain.tree_contributions(rows, trees, INPUTS, "line_id")
    total = F.aggregate("contributions", F.col("base_value"), lambda a, x: a + x["contribution"])
    return parts.select("line_id", F.round("base_value", 4).alias("base_value"), F.round(total, 4).alias("score"),
                        F.inline(explain.top_contributions(F.transform("contributions", lambda c: F.struct(
                            c["feature"].alias("feature"), F.round(c["contribution"], 4).alias("contribution"))), None)))


@catalog.add("batch_score_check", """
SELECT count(*) AS rows, count(*) AS rows_with_probabilities_of_one, count(*) AS rows_with_top_confidence FROM lineitem""")
def _(spark, sf):
    """Each row is scored once, its probabilities add up to 1 and the confidence is the larger one."""
    rows = _vectors(spark, sf)
    model = train.train(rows, "random_forest")
    p0, p1 = F.col("probability_no_turning_point"), F.col("probability_turning_point")
    return score.score_batch(model, rows, "m1", key="line_id").agg(
        F.count_distinct("prediction_id").alias("rows"),
        F.count_if(F.abs(p0 + p1 - 1) < 0.00015).alias("rows_with_probabilities_of_one"),
        F.count_if(F.col("confidence") == F.greatest(p0, p1)).alias("rows_with_top_confidence"))


@catalog.add("tree_contributions_check", """
SELECT count(*) AS rows, CAST(0 AS BIGINT) AS off, CAST(1 AS BIGINT) AS base_values FROM lineitem""")
def _(spark, sf):
    """Base value and contributions add up to the model's own score for every row."""
    rows = _vectors(spark, sf)
    model = train.train(rows, "random_forest")
    path = train.save_model(model, scratch_path(spark, "model"), "v1")
    parts = explain.tree_contributions(rows, explain.tree_nodes(spark, train.stage_path(path, model)), INPUTS, "line_id")
    total = F.aggregate("contributions", F.col("base_value"), lambda a, x: a + x["contribution"])
    scored = train.predict_rows(model, on_all_cores(rows)).select("line_id", "score")
    return parts.select("line_id", "base_value", total.alias("total")).join(scored, "line_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.abs(F.col("total") - F.col("score")) > 1e-9).alias("off"),
        F.count_distinct(F.round("base_value", 9)).alias("base_values"))


def _trained(spark, sf):
    rows = entities(spark, sf).withColumn("label", F.coalesce(F.col("n_orders") > 9, F.lit(False)).cast("int"))
    base = scratch_path(spark, "training")
    return base, training_job(spark, rows, "customer_id", "label", ["acctbal", "spend"], ["segment", "nation"], base,
                              model_type="random_forest")


@catalog.add("training_job")
def _(spark, sf):
    return _trained(spark, sf)[1].metrics


@catalog.add("training_job_check", """
SELECT 'features' AS table_name, count(*) AS num_rows, 4 AS num_features FROM customer
UNION ALL SELECT 'inference', count(*), 7 FROM customer""")
def _(spark, sf):
    """What the job left in the serving store: the chosen features and the synced data set."""
    base, _ = _trained(spark, sf)
    return ServingStore(spark, f"{base}/serving").catalog().select(
        "table_name", "num_rows", F.size("feature_columns").alias("num_features"))


# -- the whole job from the wide table -------------------------------------------------------------

_YEARS = ["2022", "2023", "2024"]
_YEAR_OF = {"2022": 1998, "2023": 1999, "2024": 2000}


def _wide_scores(spark, sf):
    """Customers with orders in all three years: a score from their spend, one from their orders, and a class, for each year."""
    year = F.year("o_orderdate")
    aggs = []
    for name, y in _YEAR_OF.items():
        hit = year == y
        spend = F.round(F.sum(F.when(hit, F.col("o_totalprice"))) / 100000, 2)
        aggs += [F.when(spend > 10, 10.0).otherwise(spend).alias(f"INDE_{name}"),  # least() would skip a null
                 F.nullif(F.count_if(hit), F.lit(0)).cast("double").alias(f"IPV_{name}"),
                 F.max(F.when(hit, F.col("o_orderpriority"))).alias(f"FASE_{name}")]
    return table(spark, sf, "orders").groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("NOME"),
                                              F.col("o_custkey").alias("customer")).agg(*aggs).dropna()


def _trained_from_wide(spark, sf):
    base = scratch_path(spark, "wide-training")
    result = training_from_wide(spark, _wide_scores(spark, sf), ["INDE", "IPV", "INDE_delta", "IPV_delta"], ["FASE"], base,
                                order=["customer", "YEAR_REF"], preparation={"years": _YEARS, "known_years": _YEARS, "tracked": ["INDE", "IPV"],
                                                                             "velocity": []})
    return base, result


@catalog.add("training_from_wide")
def _(spark, sf):
    return _trained_from_wide(spark, sf)[1].metrics


_WIDE_LABELS = " UNION ALL ".join(f"""
SELECT o_custkey, {name} AS year, round(sum(CASE WHEN year(o_orderdate) = {y} THEN o_totalprice END) / 100000, 2) AS inde,
       CAST(nullif(count(CASE WHEN year(o_orderdate) = {y} THEN 1 END), 0) AS DOUBLE) AS ipv FROM orders GROUP BY o_custkey""" for name, y in _YEAR_OF.items())


@catalog.add("training_from_wide_check", f"""
WITH w AS ({_WIDE_LABELS}), whole AS (SELECT o_custkey FROM w GROUP BY o_custkey HAVING count(inde) = 3),
l AS (SELECT CAST(inde >= 7.5 OR ipv >= 7.5 AS INTEGER) AS label, CAST(row_number() OVER (ORDER BY o_custkey, year) AS BIGINT) AS entity_id
      FROM w SEMI JOIN whole USING (o_custkey))
SELECT label, count(*) AS n, CAST(round(count(*) * 0.2::DOUBLE) AS BIGINT) AS test_rows, CAST(sum(entity_id) AS BIGINT) AS ids,
       true AS learned, count(*) AS served FROM l GROUP BY label""")
def _(spark, sf):
    """What the whole job stored: labels and entity ids as SQL finds them, the sizes of its hold-out, a model that has learned."""
    base, result = _trained_from_wide(spark, sf)
    stored = OfflineStore(spark, f"{base}/offline").get_dataset("training", "v1")
    tested = result.confusion.groupBy(F.col("label").cast("int").alias("label")).agg(F.sum("n").alias("test_rows"))
    served = ServingStore(spark, f"{base}/serving").table("inference").groupBy(F.col(TARGET).alias("label")).agg(F.count(F.lit(1)).alias("served"))
    learned = result.metrics.first()["roc_auc"] > 0.9
    own = stored.groupBy(F.col(TARGET).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum("entity_id").alias("ids"))
    return own.join(tested, "label").join(served, "label").select("label", "n", "test_rows", "ids", F.lit(learned).alias("learned"), "served")
