"""Links between texts whose signatures share a band, verified by exact Jaccard similarity.

Nodes are whole numbers, one for each distinct text. Two rounds find every component without listing a bucket's pairs:
first each node of a bucket against the bucket's least one, then, only in buckets whose nodes are still in different
components, all nodes that are not connected yet, in pieces of bounded size that pass on a spanning forest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurelake.llm.common import arrow_map, partitions, ship, slices
from featurelake.llm.components import bounded_groups, components, hook, whole_groups
from featurelake.session import cut_lineage

Sets = Callable[[str], set]
#: 64-bit hashes of the members of each text's set, repeats allowed, and the bounds of the texts among them.
Codes = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]

#: Bits of a key that number texts or pairs; the others hold a hash. Characters of text whose sets are compared at a time.
PLACES, BATCH_CHARS = 12, 1 << 17
#: Texts, and cells of the table of texts and members, up to which all pairs of a group are counted at once.
MOST, TABLE = 1024, 1 << 22
#: Bits of the largest bitmap of wanted keys.
SLOTS = 1 << 24


def jaccard(a: set, b: set) -> float:
    common = len(a & b)
    union = len(a) + len(b) - common
    return common / union if union else 1.0


def similar(a: set, b: set, least: float) -> bool:
    small, large = sorted((len(a), len(b)))
    return small >= least * large and jaccard(a, b) >= least


def hashed(sets: Sets) -> Codes:
    """Hashes by Python's own hash, for sets without a quicker way; a process hashes equal members alike."""

    def codes(texts):
        found = [np.fromiter(map(hash, sets(t)), np.int64) for t in texts]
        return np.concatenate([*found, np.empty(0, np.int64)]).view(np.uint64), np.cumsum([0, *map(len, found)])

    return codes


def keys_of(texts: list[str], codes: Codes) -> np.ndarray:
    """Sorted keys of at most 2**PLACES texts, one for each distinct hash of each text: its place, then the hash's upper bits."""
    flat, bounds = codes(texts)
    place = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(bounds))
    keys = np.sort(place << np.uint64(64 - PLACES) | flat >> np.uint64(PLACES))
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def places_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - PLACES)).astype(np.int64)


def promising(common: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of a and b members may be similar, were one member's hash to clash with another's."""
    return common + 1 >= least * (a + b - common - 1)


def certain(common: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether they are similar even so. Pairs between the two are compared by the sets themselves."""
    return common - 1 >= least * (a + b - common + 3)


def all_links(members: DataFrame, pairs: DataFrame, texts: DataFrame, sets: Sets, codes: Codes, least: float, piece: int) -> DataFrame:
    """Links a, b of both rounds; members (bucket, centre, node), pairs (centre, node) and texts (node, text) stored."""
    linked = cut_lineage(verified(pairs, texts, sets, codes, least))
    return cut_lineage(linked.unionByName(remaining_links(members, texts, linked, sets, codes, least, piece)))


def band_members(nodes: DataFrame) -> DataFrame:
    """bucket, centre (its least node) and node (any other) for every bucket of more than one node, from rows node and
    bands (null where a node has been given its bands in another row)."""
    cells = nodes.filter(F.size("bands") > 0).select("node", F.explode("bands").alias("bucket"))
    # Nearly all buckets have one node. A window moves and sorts them once, where minima and a join would do so twice.
    least = F.min("node").over(Window.partitionBy("bucket")).alias("centre")
    return cells.select("bucket", least, "node").filter("node <> centre")


def likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key (a hash) is wanted, and some others, without moving any row: a bitmap of the wanted keys' last bits, of
    ``SLOTS`` bits at most, is sent to all tasks. A join that moves rows is to follow."""
    slots = min(SLOTS, 1 << max(16, (16 * wanted.count()).bit_length()))

    word = F.shiftright(F.col(key).bitwiseAND(F.lit(slots - 1)), 6).alias("__word")
    bit = F.expr(f"shiftleft(1L, cast({key} & 63 AS int))")
    bitmap = wanted.groupBy(word).agg(F.bit_or(bit).alias("__bits"))
    return (rows.withColumn("__word", word).join(F.broadcast(bitmap), "__word")
            .filter(F.col("__bits").bitwiseAND(bit) != 0).drop("__word", "__bits"))


def verified(pairs: DataFrame, texts: DataFrame, sets: Sets, codes: Codes, least: float) -> DataFrame:
    """Links a, b among candidate pairs (centre, node) by exact Jaccard similarity."""
    left = texts.select(F.col("node").alias("centre"), F.col("text").alias("centre_text"))
    right = texts.select("node", F.col("text").alias("node_text"))
    both = pairs.join(right, "node").join(left, "centre")  # sorted by centre, whose set is then made once

    def run(batch):
        centres, nodes = batch.column("centre").to_numpy(), batch.column("node").to_numpy()
        xs, ys = batch.column("centre_text"), batch.column("node_text")
        for start, end in slices(pc.add(pc.binary_length(xs), pc.binary_length(ys)).to_pylist(), BATCH_CHARS):
            for p in range(start, end, 1 << PLACES):
                q = min(end, p + (1 << PLACES))
                x, y = xs.slice(p, q - p).to_pylist(), ys.slice(p, q - p).to_pylist()
                known: tuple[str | None, set] = (None, set())
                linked = []
                for i, sure in zip(*near_pairs(x, y, codes, least)):
                    if not sure and known[0] != x[i]:
                        known = (x[i], sets(x[i]))
                    if sure or similar(known[1], sets(y[i]), least):
                        linked.append(p + i)
                yield {"a": centres[linked], "b": nodes[linked]}

    return arrow_map(both, run, "a long, b long")


def near_pairs(x: list[str], y: list[str], codes: Codes, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places i, 2**PLACES at most in all, where the sets of x[i] and y[i] may be similar by their members' hashes, and whether that
    is certain."""
    new = np.array([i == 0 or t != x[i - 1] for i, t in enumerate(x)])
    first = np.cumsum(new) - 1
    own = keys_of([t for t, n in zip(x, new) if n], codes)
    sizes = np.bincount(places_of(own), minlength=first[-1] + 1)
    # The keys of a text that several pairs share are copied to each of them.
    ends = np.cumsum(sizes)
    at = np.repeat((ends - sizes)[first], sizes[first])
    within = np.arange(len(at)) - np.repeat(np.cumsum(sizes[first]) - sizes[first], sizes[first])
    place = np.repeat(np.arange(len(x), dtype=np.uint64), sizes[first])
    mask = np.uint64((1 << 64 - PLACES) - 1)
    left, right = place << np.uint64(64 - PLACES) | own[at + within] & mask, keys_of(y, codes)
    both = np.sort(np.concatenate([left, right]))
    common = np.bincount(places_of(both[1:][both[1:] == both[:-1]]), minlength=len(x))
    counts = common, sizes[first], np.bincount(places_of(right), minlength=len(x))
    near = np.flatnonzero(promising(*counts, least))
    return near, certain(*counts, least)[near]


def remaining_links(members: DataFrame, texts: DataFrame, linked: DataFrame, sets: Sets, codes: Codes, least: float,
                    piece: int) -> DataFrame:
    """Links inside buckets whose nodes lie in different components although every one has met the centre."""
    centres = members.groupBy("bucket").agg(F.min("centre").alias("node"))
    nodes = members.select("bucket", "node").distinct().unionByName(centres)
    placed = cut_lineage(nodes.join(components(linked), "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")))
    open_ = (placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
             .filter("low <> high AND n > 2").select("bucket"))
    rest = placed.join(open_, "bucket", "left_semi")
    # Near copies share many buckets; of those with the same nodes one is enough.
    alike = rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                       F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    rest = cut_lineage(rest.join(alike.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")), "bucket", "left_semi"))
    pieces = bounded_groups(rest, ["bucket"], "node", piece)
    keys = ["bucket", "piece_a", "piece_b"]
    together = pieces.join(texts, "node").repartition(partitions(texts), *keys).sortWithinPartitions(*keys)
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for table, starts in whole_groups(batches, keys, 2 * piece):
            nodes, roots = table.column("node").to_numpy(), table.column("root").to_numpy()
            a, b = [], []
            listed = numbered(table.column("text"), codes)
            for start, end in zip(starts, starts[1:]):
                _, first, labels = np.unique(roots[start:end], return_index=True, return_inverse=True)
                labels = first[labels]
                held = table.column("text").slice(start, end - start)
                for i, j in links_within(held, labels, sets, least, listed[start:end]):
                    a.append(nodes[start + i])
                    b.append(nodes[start + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=kinds)

    return ship(together).mapInArrow(run, "a long, b long")


def numbered(texts: pa.ChunkedArray, codes: Codes) -> list[np.ndarray]:
    """The distinct hashes of each text's set, in rising order."""
    out: list[np.ndarray] = []
    for start, end in slices(pc.binary_length(texts).to_pylist(), BATCH_CHARS):
        for p in range(start, end, 1 << PLACES):
            held = texts.slice(p, min(end - p, 1 << PLACES)).to_pylist()
            keys = keys_of(held, codes)
            ends = np.searchsorted(places_of(keys), np.arange(1, len(held) + 1))
            out += np.split(keys & np.uint64((1 << 64 - PLACES) - 1), ends[:-1])
    return out


def links_within(texts: pa.ChunkedArray, labels: np.ndarray, sets: Sets, least: float, listed: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links between texts of different labels; labels (each the place of its first text) are joined as links are found.

    ``listed`` holds the hashes of each text's set. In a small group all pairs' common members are counted by one product of the table
    of texts and members; in a large one a text is compared with all others that are not connected to it yet in one gather. Where a
    clash of two hashes would change the result, the sets themselves are compared.
    """
    if listed is None:
        listed = numbered(texts, hashed(sets))
    sizes = np.array([len(c) for c in listed])
    ends = np.cumsum(sizes)
    kinds, dense = np.unique(np.concatenate(listed), return_inverse=True)
    if len(sizes) <= MOST and len(sizes) * len(kinds) <= TABLE:
        table = np.zeros((len(sizes), len(kinds)), np.float32)
        table[np.repeat(np.arange(len(sizes)), sizes), dense] = 1
        common = table @ table.T
        low, high = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
        near = promising(common, sizes[:, None], sizes, least) & (low >= least * high) & (low > 0) & (labels[:, None] != labels)
        firm = certain(common, sizes[:, None], sizes, least)
        places = [(i, np.flatnonzero(near[i, :i])) for i in np.flatnonzero(np.tril(near, -1).any(axis=1))]
        pairs = ((i, others, firm[i, others]) for i, others in places)
    else:
        pairs = gathered(np.split(dense.astype(np.int32), ends[:-1]), sizes, len(kinds), labels, least)
    found = []
    for i, others, alike in pairs:
        mine = None
        for j, sure in zip(others, alike):
            if labels[i] != labels[j]:
                if not sure:
                    mine = sets(texts[int(i)].as_py()) if mine is None else mine
                if sure or similar(mine, sets(texts[int(j)].as_py()), least):
                    hook(labels, np.array([i]), np.array([j]))
                    found.append((int(i), int(j)))
    return found


def gathered(codes: list[np.ndarray], sizes: np.ndarray, kinds: int, labels: np.ndarray,
             least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each text, the earlier ones that may be similar to it and have another label when it is its turn, and whether that is certain."""
    mark = np.zeros(kinds, bool)
    for i in range(1, len(codes)):
        low, high = np.minimum(sizes[:i], sizes[i]), np.maximum(sizes[:i], sizes[i])
        others = np.flatnonzero((labels[:i] != labels[i]) & (low >= least * high) & (low > 0))
        if not len(others):
            continue
        mark[codes[i]] = True
        common = np.add.reduceat(mark[np.concatenate([codes[j] for j in others])], np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
        mark[codes[i]] = False
        near = promising(common, sizes[others], sizes[i], least)
        if near.any():
            yield i, others[near], certain(common, sizes[others], sizes[i], least)[near]
