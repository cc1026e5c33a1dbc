import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from featurelake.operators import features as feats
from featurelake.operators.validate import consistency_check, sample_rows, validate_payload


def test_codes_follow_code_points_and_null_is_a_category(spark):
    df = spark.createDataFrame([("b",), ("a",), ("Z",), ("Ágata",), (None,), ("a",)], "c string")
    codes = {r.value: r.code for r in feats.fit_dictionary(df, ["c"]).collect()}
    assert codes == {"None": 0, "Z": 1, "a": 2, "b": 3, "Ágata": 4}


def test_unseen_and_unfitted_columns_get_minus_one(spark):
    fitted = feats.fit_dictionary(spark.createDataFrame([("a",), ("b",)], "c string"), ["c"])
    new = spark.createDataFrame([(1, "b", "x"), (2, "new", "x"), (3, None, "x")], "id int, c string, d string")
    out = feats.apply_dictionary(new, fitted, ["c", "d"]).orderBy("id").collect()
    assert [(r.c_encoded, r.d_encoded) for r in out] == [(1, -1), (-1, -1), (-1, -1)]


def test_encoding_keeps_every_row_whatever_the_join(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(
        (F.col("id") % 7).cast("string")).alias("c"))
    dictionary = feats.fit_dictionary(rows, ["c"])
    threshold, both = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), []
    try:
        for limit in (threshold, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            both.append(feats.apply_dictionary(rows, dictionary, ["c"]).orderBy("id").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert both[0] == both[1] and len(both[0]) == 2000


def test_scaling_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0, "x"), (3.0, 5.0, None)], "x double, flat double, t string")
    out = feats.apply_scaling(df, feats.fit_scaling(df, ["x", "flat", "t"])).orderBy("x").collect()
    assert [r.x_scaled for r in out] == [-1.0, 1.0]
    assert [r.flat_scaled for r in out] == [0.0, 0.0] and [r.t_scaled for r in out] == [0.0, 0.0]


def test_missing_numbers_count_as_zero_before_fitting(spark):
    df = spark.createDataFrame([(None,), (4.0,)], "x double")
    assert feats.fit_scaling(df, ["x"]) == {"x": (2.0, 2.0)}


def test_labels(spark):
    df = spark.createDataFrame([("Sim",), (" YES ",), ("1",), ("true",), ("Não",), (None,)], "PONTO_VIRADA string")
    assert [r[0] for r in feats.create_label(df).select(feats.TARGET).collect()] == [1, 1, 1, 1, 0, 0]
    scores = spark.createDataFrame([("7.5", 1.0, "Quartzo"), ("bad", 7.6, None), ("1", 2.0, "Ágata"), ("7.4", 7.4, "Ametista")],
                                   "IPV string, INDE double, PEDRA string")
    assert [r[0] for r in feats.create_label(scores).select(feats.TARGET).collect()] == [1, 1, 1, 0]
    only = scores.select("PEDRA")
    assert [r[0] for r in feats.create_label(only).select(feats.TARGET).collect()] == [0, 0, 1, 0]


def test_scoring_defaults_add_absent_columns_only(spark):
    df = spark.createDataFrame([(None, 3.0)], "INDE_delta double, INDE double")
    row = feats.scoring_defaults(df).first()
    assert row.INDE_delta is None and row.YEAR_REF == 2022 and row.IAN_delta == 0.0 and row.INDE == 3.0


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(
        [(i, float(i % 5), None if i % 4 == 0 else float(i), ["a", "b", None][i % 3]) for i in range(60)],
        "id int, x double, y double, c string")


def test_estimator_is_a_pipeline_stage_and_survives_saving(spark, frame, base):
    stage = feats.FeatureTransform(numeric=["x", "y", "late"], categorical=["c", "gone"])
    model = Pipeline(stages=[stage]).fit(frame)
    out = model.transform(frame)
    names = ["x_scaled", "y_scaled", "late_scaled", "c_encoded", "gone_encoded"]
    assert model.stages[0].feature_names() == names
    first = out.orderBy("id").select(vector_to_array("features").alias("v"), *names).first()
    assert first.v == [float(first[n]) for n in names]
    model.write().save(base)
    again = PipelineModel.load(base).transform(frame)
    cols = ["id", *names]
    assert again.select(cols).orderBy("id").collect() == out.select(cols).orderBy("id").collect()


def test_scaled_means_are_zero(frame):
    out = feats.FeatureTransform(numeric=["x", "y"], categorical=[]).fit(frame).transform(frame)
    row = out.agg(F.avg("x_scaled"), F.avg("y_scaled")).first()
    assert abs(row[0]) < 1e-9 and abs(row[1]) < 1e-9


def test_payload_errors(spark):
    fields = [("a", "double", True), ("b", "string", True), ("n", "int", False)]
    df = spark.createDataFrame([("1.5", "x", None), ("bad", None, "3"), (None, "x", "many")], "a string, b string, n string")
    assert [r.errors for r in validate_payload(df, fields).collect()] == [[], ["a", "b"], ["a", "n"]]
    assert validate_payload(df.select("a", "b"), fields).first().errors == []
    assert validate_payload(df.select("b"), fields).first().errors == ["a"]


def test_consistency_counts_one_changed_cell_and_null_equals_null(spark):
    off = spark.createDataFrame([(1, 1.0, None), (2, 2.0, "a"), (3, 3.0, "b")], "id int, x double, s string")
    on = off.withColumn("x", F.when(F.col("id") == 2, 0.0).otherwise(F.col("x"))).withColumn(
        "_materialized_at", F.current_timestamp())
    out = {r["column"]: r for r in consistency_check(off, on, "id").collect()}
    assert {k: r.mismatches for k, r in out.items()} == {"x": 1, "s": 0}
    assert not out["x"].is_consistent and out["x"].compared_rows == 3
    same = consistency_check(off, off, "id", sample_size=2).collect()
    assert all(r.is_consistent and r.compared_rows == 2 for r in same)


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(500)
    one = sorted(r.id for r in sample_rows(df, "id", 37).collect())
    assert len(one) == 37 and one == sorted(r.id for r in sample_rows(df.repartition(9), "id", 37).collect())
    assert sample_rows(df, "id", 1000).count() == 500
