"""Fuzzy line deduplication: of all lines that are near copies of each other, directly or in a chain, one is kept.

1. Each text is cut at line feeds. A line is compared lower-cased with white space runs as one blank; lines that are
   then empty take no part and stay. Equal lines share a 64-bit key and are one node from here on.
2. Signatures: MinHash of the line's shingles of ``SHINGLE`` characters (a shorter line is its own shingle), ``BANDS``
   bands of ``DEPTH`` values. At the least similarity of 0.8 a pair shares a band with 99.5 %, at 0.9 with 99.999 %.
3. Candidates: in each band bucket, the least node with every other one. Texts are fetched for candidates only, and a
   pair is a link if the exact Jaccard similarity of the shingle sets reaches ``SIMILAR``.
4. Buckets whose nodes are still in different components after that are compared in full, in pieces of bounded size
   that pass on a spanning forest; no pair of a bucket is left untested unless its nodes are connected already.
5. Components by distributed union-find; the first line of each, in order of document id, stays.

Bucket minima are aggregated map-side before the shuffle, and joins stand where adaptive execution can split them, so a
line that a third of the documents hold, or a bucket of very many variants, never meets in one task. Keys of 64 bits can
collide: among 10**8 distinct lines the chance of one wrong pair is 3 in 10,000.

Defined results: null and empty texts have no lines and stay as they are. Rows alike in all columns are one document.
A null id counts as 0 in the order; equal ids follow by a hash of their row. Extra columns are kept by ``dedup_lines``.
A document whose lines have all been removed is left out by ``dedup_lines``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelake.llm.banding import all_links, band_members, likely
from featurelake.llm.common import arrow_map, binary_sizes, hashable, mixed, slices
from featurelake.llm.components import components
from featurelake.session import cut_lineage

#: Characters of a shingle, bands, values of a band, least Jaccard similarity, lines compared in full in one piece.
SHINGLE, BANDS, DEPTH, SIMILAR, PIECE = 8, 10, 4, 0.8, 2048
#: Bytes of text cut into lines at a time, characters whose signatures are made at a time.
BATCH_BYTES, BATCH_CHARS = 4 << 20, 1 << 16

_RANDOM = np.random.default_rng(2)
_A = _RANDOM.integers(1, 2**32, BANDS * DEPTH, dtype=np.uint32) | np.uint32(1)
_B = _RANDOM.integers(0, 2**32, BANDS * DEPTH, dtype=np.uint32)
_BAND = _RANDOM.integers(1, 2**64, (BANDS, DEPTH + 1), dtype=np.uint64) | np.uint64(1)
_BASE = 0xB5297A4D3F84D5B5


def plain(line: str) -> str:
    """The form in which lines are compared."""
    return " ".join(line.lower().split())


def shingles(line: str) -> set[str]:
    return {line[i:i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def line_set(line: str) -> set[str]:
    """Shingles of a line as it stands in a text."""
    return shingles(plain(line))


def shingle_codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of each nonempty line, repeats included, and the bounds of the lines among them.

    A shingle's hash is a polynomial of its points, made for all places at once by doubling the width.
    """
    lengths = np.array([len(x) for x in lines])
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points += np.uint64(1)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    hashes, width = points.copy(), 1
    while width < SHINGLE:
        wider = hashes[width:] * np.uint64(pow(_BASE, width, 2**64))
        hashes[:-width] += wider
        width *= 2
    # Shingles end with their line; a shorter line is one shingle, its points alone.
    whole = np.ones(len(points), bool)
    for k in range(1, SHINGLE):
        whole[ends[lengths >= k] - k] = False
    short = np.flatnonzero(lengths < SHINGLE)
    whole[starts[short]] = True
    hashes[starts[short]] = 0
    for k in range(SHINGLE - 1):
        has = short[lengths[short] > k]
        hashes[starts[has]] += points[starts[has] + k] * np.uint64(pow(_BASE, k, 2**64))
    hashes = hashes[whole]
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return hashes, np.concatenate([[0], np.cumsum(np.maximum(lengths - SHINGLE + 1, 1))])


def line_codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of lines as they stand in a text; a blank one has a point instead of none."""
    return shingle_codes([plain(x) or "\0" for x in lines])


def bands(lines: list[str]) -> np.ndarray:
    """Band hashes of nonempty lines, a row for each."""
    out = np.empty((len(lines), BANDS), np.uint64)
    for a, b in slices(map(len, lines), BATCH_CHARS):
        hashes, cuts = shingle_codes(lines[a:b])
        hashes, cuts = (hashes >> np.uint64(32)).astype(np.uint32), cuts[:-1]
        values = np.empty_like(hashes)
        least = []
        for k in range(BANDS * DEPTH):
            np.multiply(hashes, _A[k], out=values)
            np.add(values, _B[k], out=values)
            least.append(np.minimum.reduceat(values, cuts).astype(np.uint64))
        for band in range(BANDS):
            h = np.full(b - a, _BAND[band, DEPTH])
            for j in range(DEPTH):
                h = mixed(h + least[band * DEPTH + j] * _BAND[band, j])
            out[a:b, band] = h
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """The documents with a row key: __id (null as 0) and __hash of all columns that can be hashed."""
    return docs.withColumns({"__id": F.coalesce("doc_id", F.lit(0)).cast("long"), "__hash": F.xxhash64(*hashable(docs))})


def line_table(docs: DataFrame) -> DataFrame:
    """One row for each line of the keyed documents that is not blank: __id, __hash, line_no, line (its key), and the
    band hashes where it is the first of its kind in a batch."""

    def run(batch):
        for a, b in slices(binary_sizes(batch.column("text")), BATCH_BYTES):
            ids, hashes = batch.column("__id").slice(a, b - a).to_numpy(), batch.column("__hash").slice(a, b - a).to_numpy()
            seen: dict[str, int] = {}
            owner, number, place = [], [], []
            for row, text in enumerate(batch.column("text").slice(a, b - a).to_pylist()):
                for i, line in enumerate(text.split("\n")):
                    form = plain(line)
                    if form:
                        owner.append(row)
                        number.append(i)
                        place.append(seen.setdefault(form, len(seen)))
            if not seen:
                continue
            forms = list(seen)
            keys = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 7) for x in forms], np.uint64).view(np.int64)
            values = bands(forms).view(np.int64)
            places = np.array(place)
            first = np.zeros(len(places), bool)
            first[np.unique(places, return_index=True)[1]] = True
            sizes = np.where(first, BANDS, 0)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = pa.array(values[places[first]].ravel())
            listed = pa.ListArray.from_arrays(pa.array(offsets), flat)
            yield {"__id": pa.array(ids[owner]), "__hash": pa.array(hashes[owner]), "line_no": number,
                   "line": pa.array(keys[places]), "bands": listed}

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    return arrow_map(docs.select("__id", "__hash", text), run,
                     "__id long, __hash long, line_no int, line long, bands array<long>")


def line_texts(docs: DataFrame, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """line and its text for every wanted node (distinct, column line), cut out of the first document that holds it."""
    at = (lines.join(wanted, "line", "left_semi").groupBy("line")
          .agg(F.min(F.struct("__id", "__hash", "line_no")).alias("first")))
    by_doc = cut_lineage(at.select("line", "first.*").groupBy("__id", "__hash")
                         .agg(F.collect_list(F.struct("line_no", "line")).alias("cut")))
    holding = likely(docs.select("__id", "__hash", "text"), by_doc, "__hash")
    found = holding.join(by_doc, ["__id", "__hash"]).withColumn("parts", F.split("text", "\n", -1))
    picked = F.transform("cut", lambda c: F.struct(c["line"].alias("line"), F.element_at("parts", c["line_no"] + 1).alias("text")))
    # Rows alike in all columns give the same line twice.
    return found.select(F.explode(picked).alias("c")).select("c.*").dropDuplicates(["line"])


def line_classes(docs: DataFrame) -> DataFrame:
    """Every line of the keyed documents that is not blank: __id, __hash, line_no, the place of the line its component
    keeps (class_id, class_hash, class_line_no), and whether it is that line (kept)."""
    lines = cut_lineage(line_table(docs))
    members = cut_lineage(band_members(lines.withColumnRenamed("line", "node")))
    pairs = members.select("centre", "node").distinct()
    wanted = members.select(F.explode(F.array("centre", "node")).alias("line")).distinct()
    texts = cut_lineage(line_texts(docs, lines, wanted)).withColumnRenamed("line", "node")
    names = components(all_links(members, pairs, texts, line_set, line_codes, SIMILAR, PIECE)).withColumnRenamed("node", "line")
    firsts = lines.groupBy("line").agg(F.min(F.struct("__id", "__hash", "line_no")).alias("first"))
    of_root = names.join(firsts, "line").groupBy("root").agg(F.min("first").alias("class"))
    # Stored, so that the last join stands alone and adaptive execution can split a line that many documents hold.
    classes = cut_lineage(firsts.join(names.join(of_root, "root").select("line", "class"), "line", "left")
                          .select("line", F.coalesce("class", "first").alias("class")))
    placed = lines.select("__id", "__hash", "line_no", "line").join(classes, "line")
    return placed.select("__id", "__hash", "line_no", F.col("class.__id").alias("class_id"), F.col("class.__hash").alias("class_hash"),
                         F.col("class.line_no").alias("class_line_no"),
                         (F.struct("__id", "__hash", "line_no") == F.col("class")).alias("kept"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with the lines that their components keep, and blank lines as they were. Documents that lose all
    their lines go."""
    rows = keyed(docs)
    dropped = (line_classes(rows).groupBy("__id", "__hash")
               .agg(F.collect_set(F.when(~F.col("kept"), F.col("line_no"))).alias("dropped"), F.count_if("kept").alias("left")))
    packed = rows.select("__id", "__hash", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    joined = packed.dropDuplicates(["__id", "__hash"]).join(dropped, ["__id", "__hash"], "left").filter("left IS NULL OR left > 0")
    numbered = F.filter(F.split("doc.text", "\n", -1), lambda _, i: ~F.array_contains("dropped", i))
    text = F.when(F.size("dropped") > 0, F.array_join(numbered, "\n")).otherwise(F.col("doc.text"))
    return joined.select("doc", text.alias("new")).select(
        *[F.col("new").alias("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])
