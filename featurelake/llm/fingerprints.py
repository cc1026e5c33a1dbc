"""Document fingerprints: MinHash over word shingles.

A fingerprint holds, for each of ``HASHES`` universal hash permutations, the least value over the text's shingles of
five words (A-Z lower-cased). Permutation k maps a shingle's 64-bit hash x to the upper half of a_k * x + b_k modulo
2**64; numpy evaluates it for all shingles of a batch at once. The share of equal places estimates the Jaccard
similarity of two texts' shingle sets.

``near_duplicates`` cuts fingerprints into bands, joins equal bands in Spark, and verifies candidate pairs by the exact
Jaccard similarity of their shingle sets. Equal texts are made one class first; within a band only links from each
class to the band's least one are candidates in a first round, and what a round leaves in different components meets
in the next, so no group's pairs are ever listed in full and no link between different texts is lost.

``compare`` pairs each document with the next one in order of id. Ids are cut into ranges at explicit quantiles; the
first document of each range is copied to the end of the range before, so every range knows its successor without any
global order in one task, and texts are shuffled once.

Defined results: null counts as empty. A text without words has the fingerprint of all highest values; two such are
alike in full. A text of fewer than five words has its whole sequence as its only shingle. Documents of equal id follow
each other in order of their text's hash; a null id comes after all others. A single document is its own successor.
Repeated rows each get a row; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelake.llm.banding import all_links, band_members, likely
from featurelake.llm.common import arrow_map, hashable, mixed, partitions, shingle_hashes, ship, slices, word_hashes
from featurelake.llm.components import components
from featurelake.session import cut_lineage

#: Hash permutations, words of a shingle.
HASHES, WORDS = 128, 5
#: Bands, values of a band, least Jaccard similarity, texts compared in full in one piece. A pair at the least similarity
#: shares a band with 99.8 %.
BANDS, DEPTH, SIMILAR, PIECE = 21, 6, 0.8, 512
#: Bytes of text hashed at a time.
BATCH_BYTES = 1 << 20
#: Ranges of ids for each shuffle partition.
RANGES = 4

_RANDOM = np.random.default_rng(8)
_A = _RANDOM.integers(1, 2**64, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _RANDOM.integers(0, 2**64, HASHES, dtype=np.uint64)
_HIGHEST = np.uint32(0xFFFFFFFF)


def minhashes(texts: list[bytes]) -> np.ndarray:
    """Fingerprint of each text, a row of HASHES 32-bit values."""
    words, bounds = word_hashes([t.lower() for t in texts])
    shingles, cuts = shingle_hashes(words, bounds, WORDS)
    out = np.full((len(texts), HASHES), _HIGHEST)
    full = np.flatnonzero(np.diff(cuts))
    if len(full):
        starts = cuts[:-1][full]
        for k in range(HASHES):
            values = (shingles * _A[k] + _B[k]) >> np.uint64(32)
            out[full, k] = np.minimum.reduceat(values, starts)
    return out


def packed(prints: np.ndarray) -> list[bytes]:
    """Fingerprints as bytes, highest first, so that their hexadecimal form reads value by value."""
    data = prints.astype(">u4").tobytes()
    width = HASHES * 4
    return [data[i:i + width] for i in range(0, len(data), width)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def word_set(text: str) -> set[tuple[bytes, ...]]:
    words = text.encode().lower().split()
    return {tuple(words[i:i + WORDS]) for i in range(len(words) - WORDS + 1)} or ({tuple(words)} if words else set())


def word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the members of word_set of each text, repeats included, and the bounds of the texts among them."""
    return shingle_hashes(*word_hashes([t.encode().lower() for t in texts]), WORDS)


def band_hashes(prints: np.ndarray) -> np.ndarray:
    """One number for each of BANDS stretches of DEPTH values of each fingerprint."""
    out = np.empty((len(prints), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(prints), _B[band] | np.uint64(1))
        for j in range(DEPTH):
            h = mixed(h + prints[:, band * DEPTH + j].astype(np.uint64) * _A[band])
        out[:, band] = h
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and class_id, the least doc_id among the texts joined by links of similarity SIMILAR or more, for every
    document. Texts are known by 64-bit hashes; a class of null ids alone has a null id."""
    prints, named = classified(docs)
    return prints.select("doc_id", "node").join(named, "node", "left").select("doc_id", "class_id")


def classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored doc_id, node and bands of every document, and class_id of every node."""
    rows = noded(docs)

    def run(batch):
        texts = batch.column("text").to_pylist()
        for a, b in slices(map(len, texts), BATCH_BYTES):
            values = band_hashes(minhashes([t.encode() for t in texts[a:b]])).view(np.int64)
            yield {"doc_id": batch.column("doc_id").slice(a, b - a), "node": batch.column("node").slice(a, b - a),
                   "bands": list(values)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = cut_lineage(arrow_map(rows, run, f"doc_id {kind}, node long, bands array<long>"))
    return prints, classes(prints, rows)


def noded(docs: DataFrame) -> DataFrame:
    """doc_id, node (the text's hash) and text (null as empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("node"), text.alias("text"))


def classes(prints: DataFrame, rows: DataFrame) -> DataFrame:
    """class_id of every node, from stored rows doc_id, node, bands, and the texts of rows node, text."""
    prints = prints.select("doc_id", "node", "bands")
    members = cut_lineage(band_members(prints))
    pairs = members.select("centre", "node").distinct()
    wanted = cut_lineage(members.select(F.explode(F.array("centre", "node")).alias("node")).distinct())
    texts = cut_lineage(likely(rows.select("node", "text"), wanted, "node").join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    roots = components(all_links(members, pairs, texts, word_set, word_codes, SIMILAR, PIECE))
    nodes = cut_lineage(prints.groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left")
                        .select("node", "least", F.coalesce("root", "node").alias("root")))
    return nodes.join(nodes.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("node", "class_id")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One document of each class, with its own columns: the one of least doc_id, a null id only if there is no other;
    of equal ids the one whose columns hash lowest, and one of rows alike in all columns."""
    rows = docs.withColumns({"__row": F.xxhash64(*hashable(docs)), "__twin": F.xxhash64(F.lit(1), *hashable(docs))})
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__row").alias("row"), F.col("__twin").alias("twin"))
    named = near_duplicates(rows.select(order.alias("doc_id"), "text"))
    kept = (named.filter(F.col("doc_id") == F.col("class_id"))
            .select(F.col("doc_id.row").alias("__row"), F.col("doc_id.twin").alias("__twin")).distinct())
    packed = rows.select("__row", "__twin", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    return packed.join(kept, ["__row", "__twin"], "left_semi").dropDuplicates(["__row", "__twin"]).select("__doc.*")


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many code points, or all, from the next one's start."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def ordered(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Ranges of ids, each whole in one partition and in order, with a copy of the next range's first document last:
    range, copied, doc_id, h, text (null as empty), class_id (null). Documents alike in id and h follow their row of ``known``
    (doc_id, h, class_id), which has no text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"))
    n = partitions(docs)
    steps = [i / (RANGES * n) for i in range(1, RANGES * n)]
    cuts = docs.select(F.col("doc_id").cast("double").alias("at")).approxQuantile("at", steps, 1 / (8 * RANGES * n))
    splits = [-float("inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    cutter = Bucketizer(splits=splits, inputCol="at", outputCol="range", handleInvalid="keep")

    def ranged(rows):
        return cutter.transform(rows.withColumn("at", F.col("doc_id").cast("double"))).withColumn("range", F.col("range").cast("int")).drop("at")

    bucketed = ranged(rows)
    # One row for each range, so this is as small as the list of cuts.
    firsts = (bucketed.groupBy("range").agg(F.min(F.struct("doc_id", "h")).alias("first"))
              .select("range", "first.doc_id", "first.h").orderBy("range").collect())
    ahead = [(r["doc_id"], r["h"], firsts[i - 1]["range"]) for i, r in enumerate(firsts)]
    next_first = docs.sparkSession.createDataFrame(ahead, "doc_id long, h long, before int")
    copied = (bucketed.drop("range").alias("d").join(
        F.broadcast(next_first).alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.h") == F.col("k.h")))
        .select(F.col("before").alias("range"), F.lit(True).alias("copied"), "d.doc_id", "d.h", "text"))
    whole = bucketed.select("range", F.lit(False).alias("copied"), "doc_id", "h", "text").unionByName(copied).withColumn(
        "class_id", F.lit(None).cast("long"))
    if known is not None:
        whole = whole.unionByName(ranged(known).withColumns({"copied": F.lit(False), "text": F.lit(None).cast("string")}))
    return whole.repartition(n, "range").sortWithinPartitions(
        "range", "copied", F.col("doc_id").asc_nulls_last(), "h", F.col("text").isNotNull())


def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list, list]]:
    """Ids, texts, next texts and classes, about ``BATCH_BYTES`` characters at a time, from batches of an ordered partition."""
    held, own, size = None, None, 0
    ids, texts, follows, classes = [], [], [], []
    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("range", "copied", "doc_id", "text", "class_id"))):
            row = tuple(x.as_py() for x in row)
            if row[3] is None:  # the class of the documents that follow
                own = row[4]
                continue
            if held is not None and not held[1] and held[0] == row[0]:
                ids.append(held[2])
                texts.append(held[3])
                follows.append(row[3])
                classes.append(held[4])
                size += len(held[3])
                if size > BATCH_BYTES:
                    yield ids, texts, follows, classes
                    ids, texts, follows, classes, size = [], [], [], [], 0
            held = (*row[:4], own)
    if ids:
        yield ids, texts, follows, classes


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next (null texts as empty), the next document being that of the following id."""
    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("next", pa.string())])

    def run(batches):
        for found in followed(batches):
            yield pa.RecordBatch.from_arrays([pa.array(v, k.type) for v, k in zip(found, kinds)], schema=kinds)

    return ship(ordered(docs)).mapInArrow(run, "doc_id long, text string, next string")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, its edited text and the next text, their likeness, and the text's class of near copies.

    Classes are found first, from bands alone, and travel with the texts, so that no fingerprint is stored or moved. Pairing and
    hashing are one pass in one Python worker per task.
    """
    kinds = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("own", pa.binary()),
                       ("edited", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("class_id", pa.int64())])

    def run(batches):
        for ids, texts, following, named in followed(batches):
            mine, after = [t.encode() for t in texts], [f.encode() for f in following]
            changed = [edited(t, f).encode() for t, f in zip(texts, following)]
            own, other = minhashes(mine), minhashes(changed)
            # Rows follow each other, so the next text is mostly the next row's own.
            lone = [i for i in range(len(ids)) if i + 1 == len(ids) or after[i] != mine[i + 1]]
            nxt = np.concatenate([own[1:], own[:1]])
            nxt[lone] = minhashes([after[i] for i in lone])
            columns = [ids, [len(t) for t in texts], [hashlib.sha256(t).hexdigest() for t in changed], packed(own),
                       packed(other), likeness(own, other), likeness(own, nxt), named]
            yield pa.RecordBatch.from_arrays([pa.array(v, k.type) for v, k in zip(columns, kinds)], schema=kinds)

    prints, named = classified(docs)
    known = cut_lineage(prints.select("doc_id", "node").distinct().join(named, "node", "left")
                        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("node").alias("h"), F.col("class_id").cast("long").alias("class_id")))
    return ship(ordered(docs, known)).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, own binary, edited binary, near_edited double, near_next double, "
             "class_id long").select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("own")).alias("fingerprint"),
        F.lower(F.hex("edited")).alias("edited_fingerprint"), "near_edited", "near_next", "class_id")
