"""SimHash near-duplicates by bit-sliced comparison.

``fingerprints`` gives each text 64 bits: for all its shingles of four words (A-Z lower-cased, repeats included), bit i
is 1 if it is set in over half of their XXH64 hashes (seed 42). ``near_duplicates`` links fingerprints that differ in at
most ``RADIUS`` bits and gives each document its component.

Candidates come from equal parts: of ``BLOCKS`` stretches of bits, two fingerprints within the radius agree in at least
BLOCKS - RADIUS, so they share a bucket in one of the tables made from all such choices. Inside a bucket, the bits are
stored vertically: one 64-bit word holds the same bit of 64 fingerprints. A fingerprint is compared with 64 others at a
time by adding the differing bits of each plane into carry-save counters, and a block of 64 is abandoned once all its
counters exceed the radius. A bucket emits a spanning forest of the links it finds, never all pairs.

Equal fingerprints are one node throughout. A bucket above ``SPLIT`` nodes is cut into pieces that meet pairwise, so a
task's memory is bounded. Components are found by distributed union-find.

Defined results: null and empty texts, and texts of white space, have no shingle and fingerprint zero, linked like any
other. Fewer than four words make one shingle. The component's id is the least doc_id in it; documents with a null id
take part, and a component of only such has a null id. Repeated rows each get a row; extra columns are left out.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelake.llm.common import arrow_map, hashable, partitions, ship, text_bytes
from featurelake.llm.components import bounded_groups, components, hook, whole_groups
from featurelake.session import cut_lineage

#: Differing bits that still link; stretches of the fingerprint; nodes of a bucket compared in one piece.
RADIUS, BLOCKS, SPLIT = 4, 6, 2048
#: Words of a shingle, seed of its hash.
WORDS, SEED = 4, 42
#: Planes between two looks at which blocks are still open; pairings of a fingerprint and a block at a time.
LOOK, PAIRINGS = 8, 1 << 15
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[WORDS - 1:]) if len(words) >= WORDS else [(0, len(joined))]
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed number) and other whole-number columns of every text."""

    def run(batch):
        made = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64)
        yield {c: batch.column(c) for c in ("doc_id", *others)} | {"fp": pa.array(made.view(np.int64))}

    schema = "doc_id long, fp long" + "".join(f", {c} long" for c in others)
    return arrow_map(docs.select("doc_id", *others, text_bytes().alias("text")), run, schema)


def block_masks(blocks: int) -> list[int]:
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def buckets(nodes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """part, key and fp: each fingerprint once for every choice of blocks that two within the radius may agree in."""
    rows = []
    for i, chosen in enumerate(combinations(block_masks(blocks), blocks - radius)):
        mask = sum(chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        rows.append(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(signed)).alias("key")))
    return nodes.select("fp", F.explode(F.array(*rows)).alias("b")).select("b.part", "b.key", "fp")


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes of a multiple of 64 fingerprints: row b, word w holds bit b of the 64 fingerprints of block w."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    packed = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)[:, :, 0]


def beyond(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count exceeds the radius, compared from the highest bit down."""
    more, equal = over.copy(), np.full_like(over, _ALL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            more |= equal & counters[k]
            equal &= ~counters[k]
    return more


def within(planes: np.ndarray, query: np.ndarray, block: np.ndarray, alive: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairings of a fingerprint and a block have lanes within the radius, and those lanes."""
    index = np.arange(len(query))
    counters = [np.zeros(len(query), np.uint64) for _ in range((radius + 1).bit_length())]
    over = np.zeros(len(query), np.uint64)
    for b in range(64):
        carry = planes[b][block] ^ (np.uint64(0) - ((query >> np.uint64(b)) & np.uint64(1)))
        for k, count in enumerate(counters):
            counters[k], carry = count ^ carry, count & carry
        over |= carry
        if b % LOOK == LOOK - 1:
            alive = alive & ~beyond(counters, over, radius)
            open_ = alive != 0
            if not open_.all():
                index, query, block, alive, over = (x[open_] for x in (index, query, block, alive, over))
                counters = [c[open_] for c in counters]
            if not len(index):
                break
    return index, alive


def forest(values: np.ndarray, starts: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the place of the first one it is linked with, directly or not, inside its group."""
    labels = np.arange(len(values))
    sizes = np.diff(starts)
    several = sizes > 1
    sizes, begin = sizes[several], starts[:-1][several]
    if not len(sizes):
        return labels
    blocks = -(-sizes // 64)
    first = np.concatenate([[0], np.cumsum(blocks)])
    offset = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(offset)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    item = begin[offset] + inside
    lane = first[:-1][offset] * 64 + inside
    holder = np.full(first[-1] * 64, -1)
    holder[lane] = item
    padded = np.zeros(len(holder), np.uint64)
    padded[lane] = values[item]
    planes = planes_of(padded)
    filled = np.packbits(holder.reshape(-1, 64) >= 0, axis=1, bitorder="little").view(np.uint64)[:, 0]
    own = lane // 64
    reach = first[1:][offset] - own  # a fingerprint meets its own block and those after it
    ends = np.cumsum(reach)
    for a in range(0, int(ends[-1]), PAIRINGS):
        number = np.arange(a, min(a + PAIRINGS, int(ends[-1])))
        who = np.searchsorted(ends, number, side="right")
        block = own[who] + number - (ends[who] - reach[who])
        later = np.where((lane[who] % 64) == 63, np.uint64(0), _ALL << ((lane[who] % 64 + 1) % 64).astype(np.uint64))
        alive = filled[block] & np.where(block == own[who], later, _ALL)
        some = alive != 0
        who, block, alive = who[some], block[some], alive[some]
        index, lanes = within(planes, padded[lane[who]], block, alive, radius)
        row, bit = np.nonzero(np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        hook(labels, item[who[index[row]]], holder[block[index[row]] * 64 + bit])
    return labels


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, split: int = SPLIT) -> DataFrame:
    """Links a, b between the distinct fingerprints of nodes (fp) whose components are those of all pairs in radius."""
    cells = bounded_groups(buckets(nodes, radius, blocks), ["part", "key"], "fp", split)
    keys = ["part", "key", "piece_a", "piece_b"]
    together = cells.repartition(partitions(nodes), *keys).sortWithinPartitions(*keys)
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for table, starts in whole_groups(batches, keys):
            signed = table.column("fp").to_numpy()
            labels = forest(signed.view(np.uint64), starts, radius)
            linked = np.flatnonzero(labels != np.arange(len(labels)))
            yield pa.RecordBatch.from_arrays([pa.array(signed[linked]), pa.array(signed[labels[linked]])], schema=kinds)

    return ship(together).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, split: int = SPLIT) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    prints = cut_lineage(fingerprints(docs))
    return with_components(prints, radius, blocks, split).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def with_components(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, split: int = SPLIT) -> DataFrame:
    """The rows (doc_id, fp and others) with component_id. The rows should be a stored table; they are read twice."""
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"), radius, blocks, split))
    rooted = cut_lineage(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                         .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp", "left")


def distinct_documents(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, split: int = SPLIT) -> DataFrame:
    """One document of each component, with its own columns: the one of least doc_id, a null id only if there is no
    other; of equal ids the one whose columns hash lowest, and one of rows alike in all columns."""
    rows = docs.withColumns({"__row": F.xxhash64(*hashable(docs)), "__twin": F.xxhash64(F.lit(1), *hashable(docs))})
    prints = cut_lineage(fingerprints(rows, "__row", "__twin"))
    classed = with_components(prints.withColumn("doc_id", F.struct(F.col("doc_id").isNull(), "doc_id", "__row", "__twin")),
                              radius, blocks, split)
    kept = classed.filter(F.col("doc_id") == F.col("component_id")).select("__row", "__twin").distinct()
    packed = rows.select("__row", "__twin", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    return packed.join(kept, ["__row", "__twin"], "left_semi").dropDuplicates(["__row", "__twin"]).select("__doc.*")
