"""Registered queries opN_<name>: each applies its operator with production parameters to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelake.llm import (bpe, conversations, fingerprints, language, language_model, line_dedup, mixing, neighbours, simhash,
                             substrings, token_counts, url_filter, whitening)
from featurelake.llm.common import crc_part, tokenizer_file
from featurelake.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Tokens a document may have.
TOKEN_LIMIT = 2048


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@add("op1_language_model")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = F.coalesce(crc_part("doc_id", 5) == 1, F.lit(False))
    return language_model.score(docs, ~held_out).withColumn("held_out", ~F.col("learned")).drop("learned")


@add("op2_line_dedup")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    lines = line_dedup.line_classes(line_dedup.keyed(table(spark, sf, "documents")))
    return lines.select(F.col("__id").alias("doc_id"), "line_no", F.col("class_id").alias("class_doc_id"), "class_line_no", "kept")


@add("op3_language_id")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = F.coalesce(crc_part("doc_id", 4) == 2, F.lit(False))
    model = language.fit(docs, ~held_out)
    return language.label(docs, model).withColumn("held_out", held_out)


@add("op4_simhash")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


# The mix in SQL: the same targets, order, offset and whole arithmetic.
MIX = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sizes AS (SELECT k, min(source) AS source, sum(size)::BIGINT AS source_size FROM docs GROUP BY k),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))::DOUBLE
            / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level
  FROM weighed
  WINDOW before AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT arg_min(level, source_size / w) AS level FROM levels WHERE level * w <= 3 * source_size),
targets AS (
  SELECT k, source_size, least(final.level * w, (3 * source_size)::DOUBLE) AS target FROM levels, final),
ranked AS (
  SELECT d.*, t.source_size, t.target,
         row_number() OVER (
           PARTITION BY d.k
           ORDER BY CASE WHEN size > 0 THEN floor(log2(size)) ELSE -1 END, bucket, size, doc_id)::HUGEINT AS r,
         CASE WHEN t.source_size > 0 THEN floor(least(t.target / t.source_size, 3.0::DOUBLE) * 1e12) ELSE 0 END::HUGEINT AS rate,
         floor(('0x' || md5('mix' || d.k)[1:8])::BIGINT::DOUBLE / 4294967296 * 1e12)::HUGEINT AS shift
  FROM (SELECT *, coalesce((doc_id % 256 + 256) % 256, -1) AS bucket FROM docs) d JOIN targets t USING (k))
SELECT doc_id, source, size, source_size, target,
       ((r * rate + shift) // 1000000000000 - ((r - 1) * rate + shift) // 1000000000000)::BIGINT AS copies,
       (((r * rate + shift) // 1000000000000 - ((r - 1) * rate + shift) // 1000000000000) * size)::BIGINT AS taken
FROM ranked
"""


@add("op5_source_mix", MIX)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


@add("op6_token_counts")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf, "documents"), tokenizer_file("word_bpe_49k.json"),
                                       scratch_path(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


# The rules: host and path, verdict.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
         ("net/fr/", "block")]


@add("op7_url_filter")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(table(spark, sf, "pages"), RULES)


@add("op8_fingerprints")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf, "documents"))


@add("op9_nearest")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@add("op10_bpe_round_trip")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"))


@add("op11_whitening")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


# Windows as text, the first document of each, and the words that no window with an earlier first document covers.
SUBSTRINGS = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM docs),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS text FROM places),
marks AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY text) AS first FROM windows) WHERE first < doc_id),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM marks),
gone AS (SELECT doc_id, count(*) AS n, list(i) AS taken FROM covered GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN words ELSE
         list_where(words, list_transform(range(1, len(words) + 1), lambda j: NOT list_contains(taken, j))) END, ' ')) AS kept_sha256
FROM docs LEFT JOIN gone USING (doc_id)
"""


@add("op12_substring_dedup", SUBSTRINGS)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    kept = substrings.dedup_substrings(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@add("op13_conversation_repair")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf, "conversations")), live="live")
