"""Scoring texts with an n-gram language model in the form of a weighted backoff automaton.

Model: with Dirichlet smoothing, p(w|h) = (c(hw) + M p(w|h')) / (c(h) + M), h' being h without its first word, down to
p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), where all unknown words share one place. Each n-gram that precedes something is
a state; an n-gram that was seen is an arc with weight log p(w|h); where a state has no arc for a word, its failure arc
leads to the state of h' at the cost log(M / (c(h) + M)). Both forms give the same number.

How it runs. Counts, and the automaton, are as large as the corpus asks for and stay distributed:

1. ``batches``: documents are packed into batches of about ``BATCH_BYTES`` of text, words numbered within a batch, and
   stored once as a table in the shared folder.
2. ``counted``: each batch sends its distinct n-grams, already summed up, to shards by their hash, packed as arrays. A
   shard adds up what all batches sent and answers every batch with the totals of the n-grams it asked for. An n-gram
   that a third of all tokens belong to is one entry per batch, so no key is hot.
3. ``scored``: batch and answers meet; the part of the automaton its texts can reach is built, and one traversal from
   left to right per text carries the state and adds up log-probabilities.

Words are known by 64-bit hashes. Memory of a task is bounded by the size of a batch, and by a shard's share of the
n-grams; a batch of one very long text is as large as that text.

Defined results: null counts as empty; an empty text is its end token alone. Without training text N, V and all counts
are 0 and every word has probability 1. Repeated rows each get a row (and each teach); extra columns are left out.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelake.llm.common import arrow_map, binary_sizes, mixed, partitions, ship, slices, text_bytes
from featurelake.session import cut_lineage

#: Words of the longest n-gram, strength of the prior M, share added to a word's count.
ORDER, PRIOR, ADDED = 2, 32.0, 0.5
#: Bytes of text in a batch.
BATCH_BYTES = 4 << 20
#: Hashes of the end token and of the mark before the first word. Keys of words are even, all others odd.
END, BEGIN = 0x5BD1E9955BD1E994, 0x1B873593CC9E2D51
_STEP = np.random.default_rng(1).integers(1, 2**64, 16, dtype=np.uint64) | np.uint64(1)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes as the largest needs, lowest bytes of all first, so that blocks compress."""
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(planes.T).tobytes()


def unpack(data) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :len(planes)] = planes.T
    return out.view("<u8").ravel()


def batches(docs: DataFrame, learn: Column) -> DataFrame:
    """One row per batch: doc_ids, learn, sizes (tokens of each text, end included), vocabulary (hashes of its distinct
    words, the end token first), words (the texts' tokens as numbers in the vocabulary)."""

    def run(batch):
        for a, b in slices(binary_sizes(batch.column("text")), BATCH_BYTES):
            part = batch.slice(a, b - a)
            numbers: defaultdict[bytes, int] = defaultdict()
            numbers.default_factory = lambda: len(numbers) + 1
            sizes, words = [], []
            for text in part.column("text").to_pylist():
                found = np.fromiter(map(numbers.__getitem__, text.lower().split()), np.uint32)
                words += [found, np.zeros(1, np.uint32)]
                sizes.append(len(found) + 1)
            hashes = np.array([END, *map(xxhash.xxh3_64_intdigest, numbers)], np.uint64) & ~np.uint64(1)
            numbers.default_factory = None
            yield {"doc_ids": [part.column("doc_id").to_pylist()], "learn": [part.column("learn").to_pylist()],
                   "sizes": [sizes], "vocabulary": [hashes.tobytes()], "words": [pack(np.concatenate(words))]}

    rows = docs.select("doc_id", learn.alias("learn"), text_bytes().alias("text"))
    packed = arrow_map(rows, run, "doc_ids array<long>, learn array<boolean>, sizes array<int>, vocabulary binary, words binary")
    return cut_lineage(packed.withColumn("batch", F.expr("uuid()")))


def grams_of(sizes: np.ndarray, vocabulary: np.ndarray, words: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams that end at each token, for n from 1 to order. Before a text's first word stands the begin
    mark; an n-gram that would begin further left repeats the next shorter one's key, marked as none by zero."""
    unigrams = vocabulary[words]
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys = [unigrams]
    for n in range(2, order + 1):
        # The word n-1 to the left, or the begin mark just before the first word.
        left = np.concatenate([np.full(n - 1, BEGIN, np.uint64), unigrams[:1 - n]])[:len(words)]
        left[place == n - 2] = np.uint64(BEGIN)
        longer = mixed(keys[-1] + left * _STEP[n]) | np.uint64(1)
        longer[(place < n - 2) | (keys[-1] == 0)] = 0
        keys.append(longer)
    return keys


def contexts_of(sizes: np.ndarray, keys: list[np.ndarray], order: int) -> list[np.ndarray]:
    """Keys of the 1 to order-1 words before each token: those that end one token earlier, or the begin mark."""
    starts = np.cumsum(sizes) - sizes
    out = []
    for n in range(1, order):
        before = np.concatenate([np.zeros(1, np.uint64), keys[n - 1][:-1]])
        before[starts] = np.uint64(BEGIN if n == 1 else 0)
        out.append(before)
    return out


def unpacked(row: dict, order: int):
    sizes = np.array(row["sizes"], np.int64)
    vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
    words = unpack(row["words"])
    keys = grams_of(sizes, vocabulary, words, order)
    every = np.unique(np.concatenate([*keys, np.array([BEGIN], np.uint64)]))
    return sizes, keys, every[every != 0]


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of hashes, so the sorted keys of a request begin alike and compress."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def requests(packed: DataFrame, shards: int, order: int) -> DataFrame:
    """shard, batch, keys (sorted) and counts (in the batch's training texts), packed, of each batch's n-grams."""

    def run(part):
        for row in part.to_pylist():
            sizes, keys, every = unpacked(row, order)
            taught = np.array([x is True for x in row["learn"]])
            token = np.repeat(taught, sizes)
            counts = np.zeros(len(every), np.int64)
            for k in keys:
                seen = k[token & (k != 0)]
                if len(seen):
                    kinds, n = np.unique(seen, return_counts=True)
                    counts[np.searchsorted(every, kinds)] += n
            counts[np.searchsorted(every, np.uint64(BEGIN))] += int(taught.sum())
            shard = shard_of(every, shards)
            order_ = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order_], np.arange(shards + 1))
            sent = [i for i in range(shards) if cuts[i] < cuts[i + 1]]
            parts = [order_[cuts[i]:cuts[i + 1]] for i in sent]
            yield {"shard": sent, "batch": [row["batch"]] * len(sent), "keys": [pack(every[p]) for p in parts],
                   "counts": [pack(counts[p]) for p in parts]}

    return arrow_map(packed, run, "shard int, batch string, keys binary, counts binary")


def counted(asked: DataFrame) -> DataFrame:
    """batch, shard and totals (packed, in the order of the batch's keys of that shard); one more row per
    shard with batch null and the number of distinct words taught."""
    kinds = pa.schema([("batch", pa.string()), ("shard", pa.int32()), ("totals", pa.binary()), ("words", pa.int64())])

    def answer(table: pa.Table) -> pa.Table:
        keys = [unpack(k) for k in table.column("keys").to_pylist()]
        counts = np.concatenate([unpack(c) for c in table.column("counts").to_pylist()]).astype(np.int64)
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(len(every), np.int64)
        np.add.at(sums, where, counts)
        ends = np.cumsum([len(k) for k in keys])
        totals = [pack(sums[where[e - len(k):e]]) for k, e in zip(keys, ends)]
        words = int(((sums > 0) & (every & np.uint64(1) == 0)).sum())
        return pa.Table.from_arrays(
            [pa.array([*table.column("batch").to_pylist(), None]), pa.array([*table.column("shard").to_pylist(), None], pa.int32()),
             pa.array([*totals, None], pa.binary()), pa.array([None] * len(totals) + [words], pa.int64())], schema=kinds)

    return cut_lineage(ship(asked).groupBy("shard").applyInArrow(answer, "batch string, shard int, totals binary, words long"))


class Automaton:
    """The part of the automaton that one batch can reach, in arrays over the batch's n-grams.

    An n-gram seen in training is an arc (``weight``: log10 p of its last word after the others) out of the state of
    its first words. A gram that precedes something is a state; ``failure`` is the cost of its failure arc, which leads
    to the state shorter by its first word. State 0 words long is the root; every word has an arc there.
    """

    def __init__(self, sizes, keys, every, totals, tokens: int, distinct: int, order: int, prior: float) -> None:
        def place(k: np.ndarray) -> np.ndarray:
            return np.minimum(np.searchsorted(every, k), len(every) - 1)

        self.arc = [place(k) for k in keys]
        seen = [np.where(k != 0, totals[p], 0) for k, p in zip(keys, self.arc)]
        before = contexts_of(sizes, keys, order)
        self.context = [place(k) for k in before]
        known = [np.where(k != 0, totals[p], 0) for k, p in zip(before, self.context)]
        self.weight, self.failure = np.zeros(len(every)), np.zeros(len(every))
        chance = (seen[0] + ADDED) / (tokens + ADDED * (distinct + 1))
        self.base = np.log10(chance)
        self.weight[self.arc[0]] = self.base
        self.found = [np.ones(len(chance), bool)]
        for n in range(1, order):
            live, count = known[n - 1] > 0, known[n - 1]
            chance = np.where(live, (seen[n] + prior * chance) / (count + prior), chance)
            hit = seen[n] > 0
            self.weight[self.arc[n][hit]] = np.log10(chance[hit])
            self.failure[self.context[n - 1][live]] = np.log10(prior / (count[live] + prior))
            self.found.append(hit)
        # The state after a token: as many of the last words as precede something in training.
        starts = np.cumsum(sizes) - sizes
        self.after = np.zeros(len(chance), np.int64)
        for n in range(1, order):
            self.after[np.where(keys[n - 1] != 0, seen[n - 1] > 0, False)] = n
        self.first = int(totals[np.searchsorted(every, np.uint64(BEGIN))] > 0) if order > 1 else 0
        self.seen = seen[0] > 0
        self.starts, self.sizes = starts, sizes

    def scores(self) -> list[float]:
        """Log10 probability of each text: one pass from left to right that carries the state."""
        weight = [self.weight[a] for a in self.arc]
        cost = [np.zeros(0), *(self.failure[c] for c in self.context)]
        out = []
        for a, n in zip(self.starts.tolist(), self.sizes.tolist()):
            found = [f[a:a + n].tolist() for f in self.found]
            arcs = [w[a:a + n].tolist() for w in weight]
            fails = [c[a:a + n].tolist() for c in cost]
            total, depth = 0.0, self.first
            for i, following in enumerate(self.after[a:a + n].tolist()):
                while not found[depth][i]:
                    total += fails[depth][i]
                    depth -= 1
                total += arcs[depth][i]
                depth = following
            out.append(total)
        return out


def score(docs: DataFrame, learn: Column, order: int = ORDER, prior: float = PRIOR, shards: int | None = None) -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score and score of every text."""
    packed = batches(docs, learn)
    shards = shards or partitions(docs)
    answers = counted(requests(packed, shards, order))
    facts = packed.select(F.aggregate(F.arrays_zip("learn", "sizes"), F.lit(0).cast("long"),
                                      lambda a, x: a + F.when(x["learn"], x["sizes"].cast("long")).otherwise(0)).alias("n"))
    tokens = facts.agg(F.sum("n")).first()[0] or 0
    distinct = answers.filter("batch IS NULL").agg(F.sum("words")).first()[0] or 0
    kinds = "doc_id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    fields = pa.schema([("doc_id", pa.int64()), ("learned", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [fields.empty_table()]
        for row in left.to_pylist():
            sizes, keys, every = unpacked(row, order)
            shard = shard_of(every, shards)
            totals = np.zeros(len(every), np.int64)
            for number, found in zip(right.column("shard").to_pylist(), right.column("totals").to_pylist()):
                totals[shard == number] = unpack(found).astype(np.int64)
            automaton = Automaton(sizes, keys, every, totals, tokens, distinct, order, prior)
            starts = automaton.starts
            out.append(pa.Table.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(row["learn"], pa.bool_()), pa.array(sizes),
                 pa.array(np.add.reduceat(automaton.seen.astype(np.int64), starts)), pa.array(np.full(len(sizes), tokens)),
                 pa.array(np.add.reduceat(automaton.base, starts)), pa.array(automaton.scores(), pa.float64())], schema=fields))
        return pa.concat_tables(out)

    return (ship(packed).groupBy("batch").cogroup(answers.filter("batch IS NOT NULL").groupBy("batch")).applyInArrow(finish, kinds))
