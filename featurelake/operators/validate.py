"""Payload checks and offline/serving agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelake.functions.ordering import hash_parts
from featurelake.session import cut_lineage

# Scoring payload fields as (name, type, required).
PAYLOAD_FIELDS = [
    ("INDE", "double", True), ("IAA", "double", True), ("IEG", "double", True), ("IPS", "double", True),
    ("IDA", "double", True), ("IPP", "double", True), ("IPV", "double", True), ("IAN", "double", True),
    ("FASE", "string", True), ("PEDRA", "string", True), ("BOLSISTA", "string", True),
    ("IDADE_ALUNO", "int", False), ("ANOS_PM", "int", False),
    ("INSTITUICAO_ENSINO_ALUNO", "string", False), ("PONTO_VIRADA", "string", False),
]


def payload_errors(df: DataFrame, fields: Sequence[tuple[str, str, bool]] = PAYLOAD_FIELDS) -> Column:
    """Names of fields that are missing though required, or present but not of their type."""
    def bad(name: str, kind: str, required: bool) -> Column:
        if name not in df.columns:
            return F.lit(required)
        value = F.col(name)
        wrong = value.isNotNull() & value.try_cast(kind).isNull()
        return (value.isNull() | wrong) if required else wrong

    return F.array_compact(F.array(*[F.when(bad(n, k, r), F.lit(n)) for n, k, r in fields]))


def validate_payload(df: DataFrame, fields: Sequence[tuple[str, str, bool]] = PAYLOAD_FIELDS) -> DataFrame:
    """All rows with ``errors`` (empty when valid); callers split by ``size(errors) = 0``."""
    return df.withColumn("errors", payload_errors(df, fields))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Repeatable sample of ``n`` rows, or all rows if there are fewer.

    Rows are ranked by a seeded hash of the key: exact, and independent of partitioning.
    """
    whole = df.withColumn("__all", F.lit(0))
    picked = hash_parts(whole, "__all", key, [F.lit(n).cast("bigint")], seed, "__part")
    return picked.where(F.col("__part") == 0).drop("__part", "__all")


def consistency_check(offline: DataFrame, serving: DataFrame, entity: str, sample_size: int | None = 100,
                      ignore: Sequence[str] = ("_materialized_at",)) -> DataFrame:
    """Per common column the number of entities whose offline and serving values differ.

    Both null counts as equal; the entity itself is not compared. Columns: compared_rows, column,
    mismatches, is_consistent (over all columns).
    """
    common = [c for c in offline.columns if c in serving.columns and c != entity and c not in ignore]
    if not common:
        raise ValueError("the frames share no column besides the entity")
    left = offline.select(entity, *common)
    if sample_size is not None:
        left = sample_rows(left, entity, sample_size)
        left = cut_lineage(left)  # of a known size, by which the join is planned
    right = serving.select(entity, *[F.col(c).alias(f"__s_{c}") for c in common])
    sums = left.join(right, entity).agg(
        F.count(F.lit(1)).alias("compared_rows"),
        *[F.count_if(~F.col(c).eqNullSafe(F.col(f"__s_{c}"))).alias(c) for c in common])
    total = sum((F.col(c) for c in common), F.lit(0))
    return sums.withColumn("is_consistent", total == 0).unpivot(
        ["compared_rows", "is_consistent"], common, "column", "mismatches")


# -- whole tables ------------------------------------------------------------------------------------

# Bits of the key's hash that one level of the digest tree adds, and rows of a range that is not split any more.
LEVEL_BITS, LEAF_ROWS = 10, 64


def _comparable(df: DataFrame, c: str) -> Column:
    """A value that can be hashed and compared: a map as its sorted entries, what holds one as JSON text."""
    kind = df.schema[c].dataType.simpleString()
    if kind.startswith("map<") and kind.count("map<") == 1:
        return F.to_json(F.array_sort(F.map_entries(c)))
    return F.to_json(c) if "map<" in kind or "variant" in kind else F.col(c)


def _digested(df: DataFrame, entity: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the entity's place (its hash, unsigned in order) and two halves of the row's hash, which can be summed."""
    parts = [_comparable(df, c) for c in columns]
    # xxhash64 skips nulls, so each column also says whether it is there.
    hashed = F.xxhash64(F.lit(7), entity, *parts, *[F.col(c).isNull() for c in columns])
    return df.select("*", F.xxhash64(entity).alias("__place"), hashed.bitwiseAND(F.lit(0xFFFFFFFF)).alias("__low"),
                     F.shiftrightunsigned(hashed, 32).alias("__high"))


def _range_digests(rows: DataFrame, bits: int) -> DataFrame:
    """Count and summed hashes of every range of places; sums of equal rows add up, so repeated rows count."""
    return rows.groupBy(F.shiftrightunsigned("__place", 64 - bits).alias("__range")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("__low").alias("low"), F.sum("__high").alias("high"))


def differing_rows(left: DataFrame, right: DataFrame, entity: str, columns: Sequence[str], leaf_rows: int = LEAF_ROWS,
                   level_bits: int = LEVEL_BITS) -> tuple[DataFrame, DataFrame]:
    """Rows of both sides in those small ranges of the hashed key whose digests differ.

    A tree of digests is walked level by level: ranges that agree are left alone, those that differ are split by further bits of the
    hash until they hold at most ``leaf_rows`` rows. Each level reads both tables and shuffles digests only, at most one per
    range and task; rows move at the end, in proportion to the differences. Values count as alike when their hashes do.
    """
    sides = [_digested(df.select(entity, *columns), entity, columns) for df in (left, right)]
    bits, open_ranges = 0, None
    while True:
        bits = min(bits + level_bits, 64)
        a, b = (_range_digests(_in_ranges(side, open_ranges, bits - level_bits), bits) for side in sides)
        both = a.alias("a").join(b.alias("b"), "__range", "full_outer")
        alike = F.struct("a.n", "a.low", "a.high").eqNullSafe(F.struct("b.n", "b.low", "b.high"))
        # Stored, so that the next join is planned by the number of differing ranges.
        open_ranges = cut_lineage(both.where(~alike).select("__range", F.greatest("a.n", "b.n").alias("n")))
        largest = open_ranges.agg(F.max("n")).first()[0]
        if largest is None or largest <= leaf_rows or bits == 64:
            return tuple(_in_ranges(side, open_ranges, bits) for side in sides)


def _in_ranges(rows: DataFrame, ranges: DataFrame | None, bits: int) -> DataFrame:
    if ranges is None:
        return rows
    return rows.withColumn("__range", F.shiftrightunsigned("__place", 64 - bits)).join(ranges.select("__range"), "__range", "left_semi").drop("__range")


def consistency_full(offline: DataFrame, serving: DataFrame, entity: str, ignore: Sequence[str] = ("_materialized_at",),
                     leaf_rows: int = LEAF_ROWS, level_bits: int = LEVEL_BITS) -> DataFrame:
    """Every entity on which two tables differ: status (offline_only, serving_only, different, repeated) and the differing columns.

    All rows of both tables are compared, through digests; only rows near a difference are joined. An entity with several rows
    on a side is ``repeated`` if the sides hold different rows for it.
    """
    common = [c for c in offline.columns if c in serving.columns and c != entity and c not in ignore]
    if not common:
        raise ValueError("the frames share no column besides the entity")
    sides = []
    for name, rows in zip("ls", differing_rows(offline, serving, entity, common, leaf_rows, level_bits)):
        sides.append(rows.groupBy(entity).agg(
            F.count(F.lit(1)).alias(f"{name}_n"), F.sum("__low").alias(f"{name}_low"), F.sum("__high").alias(f"{name}_high"),
            *[F.first(_comparable(rows, c)).alias(f"{name}_{i}") for i, c in enumerate(common)]))
    left, right = (side.withColumnRenamed(entity, f"__{name}") for name, side in zip("ls", sides))
    joined = left.join(right, F.col("__l").eqNullSafe(F.col("__s")), "full_outer")
    same = F.struct("l_n", "l_low", "l_high").eqNullSafe(F.struct("s_n", "s_low", "s_high"))
    status = (F.when(F.col("s_n").isNull(), "offline_only").when(F.col("l_n").isNull(), "serving_only")
              .when((F.col("l_n") > 1) | (F.col("s_n") > 1), "repeated").otherwise("different"))
    unlike = F.array_compact(F.array(*[F.when(~F.col(f"l_{i}").eqNullSafe(F.col(f"s_{i}")), F.lit(c)) for i, c in enumerate(common)]))
    return joined.where(~same).select(F.when(F.col("l_n").isNull(), F.col("__s")).otherwise(F.col("__l")).alias(entity), status.alias("status"),
                                      F.when(status == "different", unlike).otherwise(F.array().cast("array<string>")).alias("columns"))


def key_intersection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys both frames hold."""
    return left.select(key).intersect(right.select(key))
