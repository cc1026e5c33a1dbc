"""From raw documents to token ids: language ID, line dedup, near-dedup, source mix, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; the last returns each mixed document's token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelake.llm import bpe, language, line_dedup, mixing, simhash
from featurelake.llm.common import tokenizer_file
from featurelake.session import cut_lineage

#: A document stays if at least this share of its letters is in one learned language.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language can be told: half of their letters in one language, and
    their n-grams as likely in it as in its own texts, within a margin.

    The model learns from the labels that the documents carry; a document's own label is not asked.
    """
    model = language.fit(docs, F.lit(True))
    return language.filtered(docs, model, LEAST_SHARE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one line of each group of near copies; a document that loses all its lines goes."""
    return line_dedup.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one of least doc_id: texts whose SimHashes of four-word
    shingles differ in at most four bits, directly or in a chain."""
    return simhash.distinct_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that each source comes to its target."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, whether they decode to the text (same), and n_tokens of each document."""
    return bpe.encode_checked(docs, tokenizer_file("byte_bpe_50k.json")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("source_mix", mix_sources),
    ("bpe_encoding", encode),
]

#: Fuzzy lines, the Viterbi pass and the encoder cannot be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
