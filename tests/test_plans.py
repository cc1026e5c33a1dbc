import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from featurelake.operators import prepare, train
from featurelake.operators.predictions import production_accuracy
from featurelake.plans.serving import feedback_and_log, score_and_log, score_ids_and_log
from featurelake.plans.training import training_from_wide, training_job, with_entity_id
from featurelake.sources import logs
from featurelake.sources.serving import ServingStore


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(2)
    rows = [(i, rng.uniform(4, 9), rng.choice(["Quartzo", "Ágata", None]), f"n{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, INDE double, PEDRA string, NOME string")
    return df.withColumn("label", (F.col("INDE") > 7).cast("int"))


def test_training_job_end_to_end(spark, people, base):
    result = training_job(spark, people, "id", "label", ["INDE"], ["PEDRA"], base, folds=2, numTrees=3, maxDepth=3)
    metrics = result.metrics.first()
    assert metrics.accuracy > 0.8 and 0 <= metrics.roc_auc <= 1
    assert result.cross_validation.count() == 5 and result.served_rows == 200
    store = ServingStore(spark, f"{base}/serving")
    assert {r.table_name for r in store.list_tables().collect()} == {"features", "inference"}
    cells = {(r.label, r.prediction): r.n for r in result.confusion.collect()}
    assert sum(cells.values()) == 40 and result.report.count() == 5
    assert metrics.accuracy == pytest.approx((cells[0, 0] + cells[1, 1]) / 40)
    record = train.model_records(spark, f"{base}/model").first()
    assert record.metrics["accuracy"] == metrics.accuracy and record.path == result.model_path
    assert sum(record.importances.values()) == pytest.approx(1) and max(record.importances, key=record.importances.get) == "INDE"
    loaded = train.load_latest(spark, f"{base}/model")
    raw = people.select("id", "INDE", "PEDRA")
    assert train.predict_rows(loaded, raw).select("score").collect() == train.predict_rows(result.model, raw).select("score").collect()


def test_training_from_the_wide_table(spark, base):
    rng = random.Random(3)
    rows = [(f"n{i}", *(rng.uniform(4, 9) for _ in range(4))) for i in range(120)]
    wide = spark.createDataFrame(rows, "NOME string, INDE_2021 double, INDE_2022 double, IEG_2021 double, IEG_2022 double")
    result = training_from_wide(spark, wide, ["INDE", "IEG"], [], base, ["YEAR_REF", "INDE", "IEG"], folds=2,
                                preparation={"years": ["2021", "2022"], "velocity": []}, numTrees=3, maxDepth=3)
    assert result.served_rows == 240 and result.cross_validation.count() == 5
    assert result.metrics.first().accuracy > 0.7


def test_entity_ids_are_dense(spark, people):
    ids = sorted(r.entity_id for r in with_entity_id(people, ["NOME"]).collect())
    assert ids == list(range(1, 201))


def test_scores_and_feedback_are_logged(spark, people, base):
    rows = VectorAssembler(inputCols=["INDE"], outputCol="features").transform(people.withColumn(
        "label", F.col("label").cast("double")))
    model = train.train(rows, "random_forest", numTrees=3, maxDepth=3)
    scored = score_and_log(model, rows.limit(20), ["INDE"], f"{base}/p", "v1")
    log = logs.read_log(spark, f"{base}/p", logs.PREDICTION_SCHEMA)
    assert {r.prediction_id for r in scored.collect()} == {r[0] for r in log.select("output.prediction_id").collect()}
    assert log.where("input['INDE'] IS NULL").count() == 0 and log.where("model_version = 'v1'").count() == 20

    store = ServingStore(spark, f"{base}/s")
    store.materialize(rows.select("id", "INDE", "features"), "t", "id")
    ids = spark.createDataFrame([(1,), (2,), (-5,)], "id long")
    assert score_ids_and_log(model, store, "t", ids, ["INDE"], f"{base}/p", "v1").count() == 2

    answers = scored.select("prediction_id", F.col("label").isNotNull().cast("int").alias("actual_outcome")).unionByName(
        spark.createDataFrame([("unknown", 1)], "prediction_id string, actual_outcome int"))
    matched = feedback_and_log(spark, answers, f"{base}/p", f"{base}/f")
    back = logs.read_log(spark, f"{base}/f", logs.FEEDBACK_SCHEMA)
    assert back.count() == 21 and back.where("was_correct IS NULL").count() == 1
    assert production_accuracy(matched).first().total_feedbacks == 20


def test_prepare_dataset_dispatches_on_all(spark):
    df = spark.createDataFrame([(1, 5.0, 6.0)], "id int, INDE_2021 double, INDE_2022 double")
    assert prepare.prepare_dataset(df, "2022").columns == ["id", "INDE"]
    stacked = prepare.prepare_dataset(df, "all", years=["2021", "2022"])
    assert stacked.count() == 2 and "YEAR_REF" in stacked.columns
