"""Token counts with a cache keyed by digests.

A text is normalised only as far as provably keeps its count under the given vocabulary (runs of ASCII white space
become one blank), and digested; a second digest names the tokenizer file and library. Counts already stored under both
digests are joined, distinct misses alone are encoded, and their counts are appended to the cache table.

The cache is a Parquet folder in a store all executors reach. Appends are committed by Spark's writer, so a lost
executor leaves nothing half written; two jobs that append the same digest store equal counts, and readers take one.

Skew: misses are made distinct with a map-side step before texts are shuffled, so thousands of copies of one text move
once per task. The join that gives each document its count has no aggregate above it, so adaptive execution splits a
digest that a third of the documents share.

Defined results: null counts as empty; an empty text has 0 tokens. Repeated rows each get a row; extra columns are left
out.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelake.llm.common import arrow_map, binary_sizes, slices
from featurelake.session import cut_lineage

#: Entries of a worker's memo of chunks between ASCII white space, and the longest chunk it keeps.
MEMO_ENTRIES, MEMO_BYTES = 200_000, 64
#: Bytes of text encoded at a time.
BATCH_BYTES = 4 << 20
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


class Chunks(dict):
    """Token counts by chunk. The vocabulary drops white space between words, and none of its rules looks across
    ASCII white space, so a text's count is the sum over its chunks. Starts anew when full."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def count(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text. Chunks not yet known are encoded in one batch; short ones are kept."""
        split = [t.split() for t in texts]
        new = list({c for words in split for c in words if c not in self})
        long = {}
        if len(self) + len(new) > MEMO_ENTRIES:
            self.clear()
            new = list({c for words in split for c in words})
        found = self.tokenizer.encode_batch_fast([c.decode() for c in new], add_special_tokens=False)
        for chunk, encoded in zip(new, found):
            (self if len(chunk) <= MEMO_BYTES else long)[chunk] = len(encoded.ids)
        if not long:
            return [sum(map(self.__getitem__, words)) for words in split]
        return [sum(long[c] if c in long else self[c] for c in words) for words in split]


@lru_cache(maxsize=2)
def load(path: str) -> Chunks:
    return Chunks(path)


def drops_white_space(path: str) -> bool:
    """Whether the vocabulary file splits off and removes all white space, so that chunks can be counted alone."""
    import json

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    norms = (spec.get("normalizer") or {}).get("normalizers", [])
    per_char = {"NFC", "Replace", "Lowercase"}
    return (bool(steps) and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed"
            and bool(steps[0].get("invert")) and {n["type"] for n in norms} <= per_char
            and all(not any(ch.isspace() for ch in t["content"]) and not t["lstrip"] and not t["rstrip"] and not t["single_word"]
                    for t in spec["added_tokens"]))


def tokenizer_digest(path: str) -> str:
    """Names the vocabulary file's content and the library's version."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + tokenizers.__version__.encode()).hexdigest()


def read_cache(spark, cache: str, tokenizer: str) -> DataFrame:
    """One row per digest stored for this tokenizer; an absent cache is empty."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException:
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    return (stored.filter(F.col("tokenizer") == tokenizer)
            .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))


def count_tokens(docs: DataFrame, path: str, cache: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every text; new counts are appended to the cache folder."""
    if not drops_white_space(path):
        raise ValueError("this vocabulary keeps white space; its texts cannot be normalised")
    spark, version = docs.sparkSession, tokenizer_digest(path)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"),
                        F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ").alias("content"))
    keyed = keyed.select("doc_id", "n_bytes", F.unhex(F.sha2("content", 256)).alias("digest"),
                         F.col("content").cast("binary").alias("content"))

    def encode(batch):
        for start, end in slices(binary_sizes(batch.column("content")), BATCH_BYTES):
            part = batch.slice(start, end - start)
            counts = load(path).count(part.column("content").to_pylist())
            yield {"tokenizer": [version] * len(counts), "digest": part.column("digest"), "n_tokens": counts}

    known = read_cache(spark, cache, version)
    misses = keyed.select("digest", "content").join(known, "digest", "left_anti").dropDuplicates(["digest"])
    arrow_map(misses, encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    # Stored first, so that the join stands alone and adaptive execution can split a digest that many documents share.
    counts = cut_lineage(read_cache(spark, cache, version))
    return (keyed.select("doc_id", "n_bytes", "digest").join(counts, "digest", "left")
            .select("doc_id", "n_bytes", "n_tokens"))
