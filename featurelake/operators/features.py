"""Labels, encodings, scalings and the fitted feature transform."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelake.functions.ordering import global_index
from featurelake.functions.scalars import POSITIVE_OUTCOMES, positive_flag, ratio_or_zero, to_number
from featurelake.session import cut_lineage

# Target and outcome columns, score thresholds, top tiers, default reference year.
TARGET = "ponto_virada_pred"
OUTCOME = "PONTO_VIRADA"
SCORE_THRESHOLDS = {"IPV": 7.5, "INDE": 7.5}
TOP_TIERS = {"PEDRA": ["Topázio", "Ágata"]}
DEFAULT_YEAR_REF = 2022
MISSING_CATEGORY = "None"
UNSEEN_CODE = -1

# Model inputs in fitted order.
MODEL_NUMERIC = [
    "INDE", "IAA", "IEG", "IPS", "IDA", "IPP", "IPV", "IAN", "IDADE_ALUNO", "ANOS_PM", "YEAR_REF",
    "INDE_delta", "INDE_velocity", "IPV_delta", "IPV_velocity", "IAA_delta", "IAA_velocity", "IEG_delta",
    "IEG_velocity", "IPS_delta", "IDA_delta", "IPP_delta", "IAN_delta",
]
MODEL_CATEGORICAL = ["INSTITUICAO_ENSINO_ALUNO", "FASE", "PEDRA", "BOLSISTA", "SINALIZADOR_INGRESSANTE"]


# -- labels --------------------------------------------------------------------------------------


def label_from_outcome(df: DataFrame, outcome: str = OUTCOME, name: str = TARGET,
                       accepted: Sequence[str] = POSITIVE_OUTCOMES) -> DataFrame:
    return df.withColumn(name, positive_flag(F.col(outcome), accepted))


def label_from_rules(df: DataFrame, thresholds: Mapping[str, float] = SCORE_THRESHOLDS,
                     tiers: Mapping[str, Sequence[str]] = TOP_TIERS, name: str = TARGET) -> DataFrame:
    """1 when any score reaches its threshold or a tier is a top one; absent columns are no test."""
    hit = F.lit(False)
    for c, least in thresholds.items():
        if c in df.columns:
            hit = hit | F.coalesce(to_number(F.col(c)) >= least, F.lit(False))
    for c, accepted in tiers.items():
        if c in df.columns:
            hit = hit | F.coalesce(F.col(c).isin(list(accepted)), F.lit(False))
    return df.withColumn(name, hit.cast("int"))


def create_label(df: DataFrame, outcome: str = OUTCOME, name: str = TARGET) -> DataFrame:
    """Observed outcome where the column exists, otherwise the score rules."""
    return label_from_outcome(df, outcome, name) if outcome in df.columns else label_from_rules(df, name=name)


def label_summary(df: DataFrame, name: str = TARGET) -> DataFrame:
    total, positive = F.count(F.lit(1)), F.coalesce(F.sum(F.col(name)), F.lit(0))
    return df.agg(total.alias("total"), positive.cast("bigint").alias("positives"),
                  F.round(ratio_or_zero(positive * 100.0, total), 2).alias("positive_pct"))


# -- missing columns -----------------------------------------------------------------------------


def scoring_defaults(df: DataFrame, numeric: Sequence[str] = MODEL_NUMERIC, year_key: str = "YEAR_REF",
                     year: int = DEFAULT_YEAR_REF) -> DataFrame:
    """Add absent evolution columns as 0 and the reference year as its default.

    Only columns the frame lacks altogether are added; nulls inside a column are left alone.
    """
    absent = [c for c in numeric if c not in df.columns]
    return df.withColumns({c: F.lit(year) if c == year_key else F.lit(0.0) for c in absent}) if absent else df


def add_missing_columns(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    fresh = {c: F.lit(MISSING_CATEGORY) for c in categorical if c not in df.columns}
    fresh.update({c: F.lit(0.0) for c in numeric if c not in df.columns})
    return df.withColumns(fresh) if fresh else df


# -- encoding ------------------------------------------------------------------------------------


def _category(c: str):
    """Text form of a category; a missing one is a category of its own."""
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING_CATEGORY))


def fit_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Codes 0..k-1 per column in code-point order: (column, value, code).

    Values are de-duplicated map-side for all columns in one pass, then numbered by global order,
    so a column with very many values is not sorted by a single task. The result is stored, as every
    column's lookup reads it.
    """
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), _category(c).alias("value")) for c in columns]))
    ranked = global_index(df.select(pairs).distinct(), [F.col("column"), F.col("value")], "pos")
    first = ranked.groupBy("column").agg(F.min("pos").alias("first"))
    return cut_lineage(ranked.join(F.broadcast(first), "column").select(
        "column", "value", (F.col("pos") - F.col("first")).cast("int").alias("code")))


def apply_dictionary(df: DataFrame, dictionary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<c>_encoded`` per column; values without a code, and columns never fitted, get -1.

    A stored dictionary has a known size, by which each column's join is planned.
    """
    kept = df.columns
    for c in columns:
        part = dictionary.where(F.col("column") == c).select(
            F.col("value").alias("__value"), F.col("code").alias("__code"))
        if c not in df.columns:
            known = part.where(F.col("__value") == MISSING_CATEGORY).first()
            df = df.withColumn(f"{c}_encoded", F.lit(known["__code"] if known else UNSEEN_CODE))
            continue
        df = df.join(part, _category(c) == F.col("__value"), "left").withColumn(
            f"{c}_encoded", F.coalesce(F.col("__code"), F.lit(UNSEEN_CODE))).drop("__value", "__code")
    return df.select(*kept, *[f"{c}_encoded" for c in columns])


# -- scaling -------------------------------------------------------------------------------------


def _filled(df: DataFrame, c: str):
    return F.coalesce(to_number(F.col(c)), F.lit(0.0)) if c in df.columns else F.lit(0.0)


def fit_scaling(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of every column in one aggregate; missing counts as 0."""
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.avg(_filled(df, c)).alias(f"m{i}"), F.stddev_pop(_filled(df, c)).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0) for i, c in enumerate(columns)}


def apply_scaling(df: DataFrame, scaling: Mapping[str, tuple[float, float]]) -> DataFrame:
    """``<c>_scaled`` per column; a column without spread is only centred."""
    return df.withColumns({
        f"{c}_scaled": (_filled(df, c) - F.lit(mean)) / F.lit(std if std else 1.0)
        for c, (mean, std) in scaling.items()})


# -- estimator -----------------------------------------------------------------------------------


class _FeatureParams(Params):
    numeric = Param(Params._dummy(), "numeric", "numeric inputs", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "categorical inputs", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "vector of all features", TypeConverters.toString)

    def feature_names(self) -> list[str]:
        return [f"{c}_scaled" for c in self.getOrDefault("numeric")] + [
            f"{c}_encoded" for c in self.getOrDefault("categorical")]


class FeatureTransform(Estimator, _FeatureParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits dictionary and scaling; usable as a stage of an ML Pipeline."""

    @keyword_only
    def __init__(self, *, numeric: Sequence[str] = (), categorical: Sequence[str] = (), outputCol: str = "features"):
        super().__init__()
        self._set(numeric=list(numeric), categorical=list(categorical), outputCol=outputCol)

    def _fit(self, dataset: DataFrame) -> FeatureTransformModel:
        numeric, categorical = self.getOrDefault("numeric"), self.getOrDefault("categorical")
        ready = add_missing_columns(dataset, numeric, categorical)
        scaling = fit_scaling(ready, numeric) if numeric else {}
        dictionary = fit_dictionary(ready, categorical) if categorical else None
        model = FeatureTransformModel()
        model._set(numeric=numeric, categorical=categorical, outputCol=self.getOrDefault("outputCol"),
                   means=[scaling[c][0] for c in numeric], deviations=[scaling[c][1] for c in numeric])
        return model._with_dictionary(dictionary)


class FeatureTransformModel(Model, _FeatureParams, MLReadable, MLWritable):
    """Adds encoded and scaled columns and their vector, in fitted order."""

    means = Param(Params._dummy(), "means", "fitted means", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "fitted deviations", TypeConverters.toListFloat)

    def __init__(self) -> None:
        super().__init__()
        self.dictionary: DataFrame | None = None

    def _with_dictionary(self, dictionary: DataFrame | None) -> FeatureTransformModel:
        self.dictionary = dictionary
        return self

    def scaling(self) -> dict[str, tuple[float, float]]:
        return dict(zip(self.getOrDefault("numeric"),
                        zip(self.getOrDefault("means"), self.getOrDefault("deviations"))))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        categorical = self.getOrDefault("categorical")
        df = add_missing_columns(dataset, self.getOrDefault("numeric"), categorical)
        if categorical:
            df = apply_dictionary(df, self.dictionary, categorical)
        df = apply_scaling(df, self.scaling())
        return feature_matrix(df, self.feature_names(), self.getOrDefault("outputCol"))

    def write(self) -> MLWriter:
        return _FeatureTransformWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FeatureTransformReader(cls)


class _FeatureTransformWriter(MLWriter):
    def __init__(self, instance: FeatureTransformModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        if self.instance.dictionary is not None:
            self.instance.dictionary.write.parquet(f"{path}/dictionary")


class _FeatureTransformReader(MLReader):
    def __init__(self, cls: type[FeatureTransformModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> FeatureTransformModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        if model.getOrDefault("categorical"):
            model._with_dictionary(self.sparkSession.read.parquet(f"{path}/dictionary"))
        return model


def feature_matrix(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    """Vector of those fitted features the frame has, in fitted order; a null is an error."""
    present = [c for c in features if c in df.columns]
    return VectorAssembler(inputCols=present, outputCol=output, handleInvalid="error").transform(df)


def load_transform(spark: SparkSession, path: str) -> FeatureTransformModel:
    return FeatureTransformModel.load(path)
