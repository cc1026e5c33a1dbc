import pytest
from pyspark.sql import functions as F

from featurelake.operators import prepare as prep


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy(*cols).collect()]


def test_year_slice_prefers_the_suffixed_column(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, "x")], "INDE double, INDE_2022 double, INDE_2021 double, NOME string")
    assert rows(prep.year_slice(df, "2022"), "INDE", "NOME") == [(2.0, "x")]
    assert prep.year_slice(df, "2020").columns == ["INDE", "NOME"]


def test_year_suffix_counts_only_at_the_end(spark):
    df = spark.createDataFrame([(1, 2)], "A_2021_NOTE int, A_2021 int")
    assert prep.year_slice(df, "2022").columns == ["A_2021_NOTE"]


def test_half_filled_rows_stay(spark):
    df = spark.createDataFrame([(1.0, None, "a", None), (1.0, None, None, None), (None, None, "a", "b")],
                               "x double, y double, s string, t string")
    assert rows(prep.clean_rows(df), "x", "s") == [(1.0, "a")]


def test_frame_without_numbers_keeps_its_rows(spark):
    df = spark.createDataFrame([("a", "b")], "s string, NOME string")
    assert rows(prep.clean_rows(df), "s") == [("a",)]


def test_year_key_can_be_left_out_as_evidence(spark):
    df = spark.createDataFrame([(2020, None, "a")], "YEAR_REF int, x double, s string")
    assert prep.clean_rows(df).count() == 1
    assert prep.clean_rows(df, not_evidence=["YEAR_REF"]).count() == 0


def test_imputation_takes_medians_of_the_frame_and_keeps_full_columns(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, "a"), (3, 4.0, "b"), (4, 9.0, "b")], "i int, x double, s string")
    out = prep.impute_text(prep.impute_median(df))
    assert rows(out, "i", "x", "s") == [(1, 1.0, "Desconhecido"), (2, 4.0, "a"), (3, 4.0, "b"), (4, 9.0, "b")]
    assert dict(out.dtypes)["i"] == "int"


def test_fitted_medians_are_reused(spark):
    fit = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    new = spark.createDataFrame([(None, "k"), (100.0, "k")], "x double, s string")
    preparer = prep.Preparer(impute="fitted").fit(fit)
    assert rows(preparer.transform(new), "x") == [(100.0,)]
    assert rows(prep.impute_median(new, preparer.medians), "x") == [(2.0,), (100.0,)]


def test_unfitted_preparer_refuses(spark):
    with pytest.raises(ValueError):
        prep.Preparer().transform(spark.range(1))


def test_first_year_takes_the_median_of_later_deltas(spark):
    df = spark.createDataFrame([(1, 5.0, 6.0, 8.0), (2, 5.0, 9.0, 9.0)],
                               "id int, INDE_2020 double, INDE_2021 double, INDE_2022 double")
    out = prep.prepare_multiyear(df)
    # Later deltas: 1, 4, 2, 0 with median 1.5.
    assert rows(out.where("YEAR_REF = 2020"), "id", "INDE_delta") == [(1, 1.5), (2, 1.5)]
    assert rows(out.where("YEAR_REF = 2022"), "id", "INDE_delta") == [(1, 2.0), (2, 0.0)]
    zero = prep.prepare_multiyear(df, first_year="zero")
    assert rows(zero.where("YEAR_REF = 2020"), "id", "INDE_delta") == [(1, 0.0), (2, 0.0)]


def test_zero_or_missing_previous_value(spark):
    df = spark.createDataFrame([(1, 0.0, 4.0), (2, None, 4.0), (3, 2.0, 3.0)], "id int, X_2021 double, X_2022 double")
    out = prep.yoy_wide(df, "2022", "2021", ["X"])
    assert rows(out, "id", "X_delta", "X_velocity") == [(1, 4.0, 0.0), (2, 0.0, 0.0), (3, 1.0, 0.5)]


def test_text_numbers_are_coerced_in_deltas(spark):
    df = spark.createDataFrame([(1, "2", "3.5"), (2, "n/a", "3")], "id int, X_2021 string, X_2022 string")
    assert rows(prep.yoy_wide(df, "2022", "2021", ["X"]), "id", "X_delta") == [(1, 1.5), (2, 0.0)]


def test_lag_needs_the_year_before(spark):
    df = spark.createDataFrame([(1, 2019, 1.0), (1, 2021, 5.0), (1, 2022, 6.0)], "id int, y int, x double")
    for op in (prep.yoy_lag, prep.yoy_self_join):
        assert rows(op(df, "id", "y", ["x"]), "y", "x_delta") == [(2019, 0.0), (2021, 0.0), (2022, 1.0)]


def test_stack_unifies_types_and_fills_absent_columns(spark):
    df = spark.createDataFrame([(1, 2, 2.5, "p")], "id int, A_2020 int, A_2021 double, B_2021 string")
    out = prep.stack_years(df, ["2020", "2021"])
    assert rows(out, "YEAR_REF", "A", "B") == [(2020, 2.0, None), (2021, 2.5, "p")]


def test_delimited_scan(spark, base):
    from featurelake.sources.delimited import read_delimited, resolve_source

    spark.createDataFrame([(1, "a,b", 2.5)], "i int, s string, x double").write.option("sep", ";").option(
        "header", True).csv(f"{base}.csv")
    assert rows(read_delimited(spark, f"{base}.csv"), "i", "s", "x") == [(1, "a,b", 2.5)]
    with pytest.raises(ValueError):
        read_delimited(spark, f"{base}.txt")
    assert resolve_source("s3://bucket/some/key.csv") == "s3a://bucket/some/key.csv"
    for bad in ("s3://", "s3://bucket", "s3:///key.csv"):
        with pytest.raises(ValueError):
            resolve_source(bad)


def test_stack_reads_the_wide_table_once(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_orderkey", F.col("o_totalprice").alias("P_2020"), F.col("o_totalprice").alias("P_2021"))
    plan = prep.stack_years(df, ["2020", "2021"], tracked=["P"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
