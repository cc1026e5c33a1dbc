"""Queries over run logs, model versions and their stage pointers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Stages a version can be in.
STAGE_NONE, STAGE_STAGING, STAGE_PRODUCTION = "None", "Staging", "Production"


def recent_runs(runs: DataFrame, limit: int = 100, order: Sequence | None = None) -> DataFrame:
    """Newest runs first, or by the given order columns."""
    return runs.orderBy(*(order or [F.desc("start_time"), F.desc("run_id")])).limit(limit)


def best_run(runs: DataFrame, metric: str, ascending: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """Run with the best value of a metric, the newest among equals; runs without it do not count."""
    value = F.col("metrics")[metric]
    score = -value if ascending else value
    scored = runs.where(value.isNotNull())
    return scored.groupBy(*keys).agg(
        F.max_by(F.struct("*"), F.struct(score, F.col("start_time"), F.col("run_id"))).alias("r")
    ).where("r is not null").select("r.*", value_of("r", metric))


def value_of(row: str, metric: str):
    return F.col(row)["metrics"][metric].alias("value")


def _entries(kinds: Sequence[str]):
    """All map entries of a run as one array of (kind, entry, value) with text values."""
    def of(kind: str):
        return F.transform(F.map_entries(kind), lambda e: F.struct(
            F.lit(kind).alias("kind"), e["key"].alias("entry"), e["value"].cast("string").alias("value")))

    return F.flatten(F.array(*[of(k) for k in kinds]))


def compare_runs(runs: DataFrame, ids: DataFrame | Sequence) -> DataFrame:
    """Parameters, metrics and tags of the chosen runs, one row per entry: (run_id, status,
    start_time, kind, entry, value)."""
    if isinstance(ids, DataFrame):
        chosen = runs.join(ids.select(F.col(ids.columns[0]).alias("run_id")).distinct(), "run_id", "left_semi")
    else:
        chosen = runs.where(F.col("run_id").isin(list(ids)))
    kinds = [k for k in ("params", "metrics", "tags") if k in runs.columns]
    return chosen.select("run_id", "status", "start_time", F.inline(_entries(kinds)))


def latest_per_stage(versions: DataFrame) -> DataFrame:
    """Newest version per model and stage; versions compare as numbers. The aggregate keeps one
    row per group map-side, so a model with very many versions is no hot task."""
    return versions.groupBy("name", "stage").agg(
        F.max_by("version", F.col("version").cast("bigint")).alias("version"),
        F.max_by("run_id", F.col("version").cast("bigint")).alias("run_id"))


def newest_first(versions: DataFrame, name: str) -> DataFrame:
    return versions.where(F.col("name") == name).orderBy(F.col("version").cast("bigint").desc())


def version_details(versions: DataFrame, pointers: DataFrame) -> DataFrame:
    """Versions with all their fields; an unset stage comes from the pointer (name, version, stage).

    Fields the frame lacks are null, and missing tags are an empty map.
    """
    own = F.nullif(F.nullif(F.col("v.stage"), F.lit(STAGE_NONE)), F.lit(""))
    joined = versions.alias("v").join(pointers.alias("p"), ["name", "version"], "left")

    def field(name: str, kind: str):
        value = F.col(f"v.{name}") if name in versions.columns else F.lit(None)
        return value.cast(kind)

    tags = F.coalesce(field("tags", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return joined.select(
        "name", "version", F.coalesce(own, F.col("p.stage"), F.lit(STAGE_NONE)).alias("stage"), field("status", "string").alias("status"),
        field("source", "string").alias("source"), F.col("v.run_id").alias("run_id"),
        field("creation_timestamp", "timestamp_ntz").alias("creation_timestamp"),
        field("last_updated_timestamp", "timestamp_ntz").alias("last_updated_timestamp"),
        field("description", "string").alias("description"), tags.alias("tags"))


def compare_versions(pairs: DataFrame, versions: DataFrame, runs: DataFrame) -> DataFrame:
    """Two versions side by side per metric and parameter.

    ``pairs`` holds (name, version1, version2). A version without a run shows null values, and a pair
    in which neither has any keeps one row without an entry.
    """
    known = versions.select("name", "version", "stage", "run_id")
    whole = pairs.select("name", "version1", "version2").distinct()
    for side in (1, 2):
        own = known.select("name", F.col("version").alias(f"version{side}"), F.col("stage").alias(f"stage{side}"),
                           F.col("run_id").alias(f"run{side}"))
        whole = whole.join(own, ["name", f"version{side}"], "left")
    keys = ["name", "version1", "version2", "stage1", "stage2"]
    kinds = [k for k in ("params", "metrics") if k in runs.columns]
    sides = whole.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(f"run{side}").alias("run_id")) for side in (1, 2)])))
    long = sides.join(runs.select("run_id", *kinds), "run_id", "left").select(*keys, "side", F.inline_outer(_entries(kinds)))

    def value(side: int):
        return F.max(F.when(F.col("side") == side, F.col("value"))).alias(f"value{side}")

    # Rows of sides without a run only count where the pair has no entry at all.
    entries = long.groupBy(*keys, "kind", "entry").agg(value(1), value(2))
    filled = F.max(F.col("entry").isNotNull()).over(Window.partitionBy(*keys))
    return (entries.withColumn("__filled", filled).where(F.col("entry").isNotNull() | ~F.col("__filled"))
            .select("name", "kind", "entry", "version1", "stage1", "value1", "version2", "stage2", "value2"))


def registry_status(versions: DataFrame) -> DataFrame:
    """Per model the number of versions and its newest production and staging version."""
    number = F.col("version").cast("bigint")

    def newest(stage: str):
        return F.max(F.when(F.col("stage") == stage, number))

    return versions.groupBy("name").agg(
        F.count(F.lit(1)).alias("total_versions"), newest(STAGE_PRODUCTION).alias("production_version"),
        newest(STAGE_STAGING).alias("staging_version"))
