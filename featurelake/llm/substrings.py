"""Substring dedup: words covered by a window that also starts in a document of smaller id are removed.

A window is ``WINDOW`` consecutive words. Its minimiser is the least hash of the runs of ``SEED`` words inside it, so equal
windows have equal minimisers. Consecutive windows that share one travel as one packed string, the words of all of them, to the
minimiser's bucket:

1. Minimisers are counted. Those of many strings are called hot: their windows travel one by one, and their bucket is the
   window's own hash, so no bucket grows with a frequent phrase. The list of hot ones is at most ``HOT_LIST`` numbers long.
2. Every task packs its strings. Those for one partition leave together, as compressed blocks, with their document and place.
   Equal hot windows of a block are merged, keeping the least and largest document: a passage in a third of all documents
   leaves each block once. One shuffle by bucket follows.
3. Sorted by bucket, strings are cut into windows. Sorting the windows of a stretch of buckets gives each one's first document.
   The 64-bit hashes only set aside windows that occur once; the others are grouped by their words. A place whose window
   has an earlier first document is a mark of its document.
4. Merged windows have lost their places. Those that start in two documents are named by a 128-bit digest; documents tell
   digests and places of their hot windows, and a join finds the marks.
5. Marks, gathered by document, meet its text once more.

Each window's first document is thus found over all documents, judged on the input and not on what is left.

Defined results: one row for each input row. A null text has no words; texts of fewer words than a window lose none. A null id
is larger than all others (as is the largest long), so such a document never takes words from a numbered one, and null ids
leave each other alone, as rows of equal id do. Equal rows get equal results. Rows of one id are told apart by 32 bits of
their text's hash. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelake.llm.common import _BLANK, _PLACE, binary_sizes, mixed, partitions, ship, slices, word_hashes
from featurelake.session import cut_lineage

#: Words of a window and of a minimiser, most windows in one packed string.
WINDOW, SEED, LONGEST = 13, 2, 256
#: Strings that make a minimiser hot (more, if the list would grow beyond the second number).
HOT_STRINGS, HOT_LIST = 20_000, 1_000_000
#: Bytes of texts packed at a time, bytes of strings that leave a task at a time, bytes of strings cut into windows at a time.
PACK_BYTES, BLOCK_BYTES, SORT_BYTES = 1 << 20, 8 << 20, 1 << 20
_LAST = 2**63 - 1


class Words:
    """Words of several texts side by side: bytes, starts and ends, hashes, and the bounds of the texts among the words."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = b"\n".join(texts) + b"\n"
        self.hashes, self.bounds = word_hashes(texts)
        ink = np.concatenate([[False], ~_BLANK[np.frombuffer(self.data, np.uint8)]])
        edge = np.flatnonzero(ink[1:] != ink[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]

    def places(self) -> np.ndarray:
        """First words of all windows."""
        counts = np.maximum(np.diff(self.bounds) - WINDOW + 1, 0)
        before = np.concatenate([[0], np.cumsum(counts)])
        return np.repeat(self.bounds[:-1] - before[:-1], counts) + np.arange(before[-1])

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; wrong where the text ends sooner, and never used there."""
        padded = np.concatenate([self.hashes, np.zeros(n, np.uint64)])
        h = np.full(len(self.hashes), n, np.uint64)
        for k in range(n):
            h += padded[k:k + len(h)] * _PLACE[k]
        return mixed(h)

    def cut(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """Bytes from each first to each last word."""
        data = self.data
        return [data[a:b] for a, b in zip(self.starts[first].tolist(), self.ends[last].tolist())]


def tidy(text: str | None) -> bytes:
    """Words with one blank between them; ``bytes.split`` cuts as the words are defined."""
    return b" ".join((text or "").encode().split())


def sliding_least(h: np.ndarray, n: int) -> np.ndarray:
    """Least of the n values from each place on, by doubling; the last n-1 places are not to be used."""
    width, out = 1, h.copy()
    while width < n:
        step = min(width, n - width)
        out[:-step] = np.minimum(out[:-step], out[step:])
        width += step
    return out


def strings(words: Words, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and bucket of every packed string, and whether it is a window with a hot minimiser."""
    places = words.places()
    if not len(places):
        return places, places, np.zeros(0, np.uint64), np.zeros(0, bool)
    least = sliding_least(words.grams(SEED), WINDOW - SEED + 1)[places]
    lone = np.isin(least, hot) if len(hot) else np.zeros(len(places), bool)
    new = np.ones(len(places), bool)
    new[1:] = (least[1:] != least[:-1]) | (places[1:] != places[:-1] + 1) | lone[1:]
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(places)))
    if counts.max() > LONGEST:
        parts = -(-counts // LONGEST)
        before = np.cumsum(parts) - parts
        step = np.arange(parts.sum()) - np.repeat(before, parts)
        first, counts = np.repeat(first, parts) + step * LONGEST, np.minimum(np.repeat(counts, parts) - step * LONGEST, LONGEST)
    bucket = least[first]
    if lone.any():
        bucket = np.where(lone[first], words.grams(WINDOW)[places[first]], bucket)
    return places[first], counts, bucket, lone[first]


def _text_slices(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """Tidy texts of a batch, a bounded number of bytes at a time, with further columns."""
    text = batch.column("text")
    for a, b in slices((n or 0 for n in binary_sizes(text)), PACK_BYTES):
        yield ([tidy(t.as_py()) for t in text.slice(a, b - a)], *[batch.column(c).slice(a, b - a) for c in columns])
    pa.default_memory_pool().release_unused()


def keyed(docs: DataFrame) -> DataFrame:
    """ord (the id, null last), h (the text's hash), doc_id and text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("ord"),
                       F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).bitwiseAND(F.lit(2**31 - 1)).cast("int").alias("h"), "doc_id", "text")


def hot_minimisers(rows: DataFrame, most: int | None = None) -> np.ndarray:
    """Minimisers of more strings than a bucket should hold.

    Tasks report those that they saw at least twice, so a count falls short by at most the number of tasks.
    """
    schema = pa.schema([("minimiser", pa.int64()), ("n", pa.int64())])
    none = np.zeros(0, np.uint64)

    def run(batches):
        seen, total = [], 0
        for batch in batches:
            for (texts,) in _text_slices(batch):
                seen.append(strings(Words(texts), none)[2])
                total += len(seen[-1])
        values, counts = np.unique(np.concatenate(seen or [none]), return_counts=True)
        often = counts > 1
        yield pa.RecordBatch.from_arrays([pa.array([None, *values[often].view(np.int64).tolist()], pa.int64()),
                                          pa.array([total, *counts[often].tolist()], pa.int64())], schema=schema)

    counts = cut_lineage(ship(rows.select("text")).mapInArrow(run, "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n")))
    total = counts.where(F.col("minimiser").isNull()).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    limit = max(HOT_STRINGS if most is None else most, total // HOT_LIST)
    found = counts.where(F.col("minimiser").isNotNull() & (F.col("n") > limit)).select("minimiser").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


#: Columns of strings: of merged ones, h and start are null. Buckets keep 32 bits; where two share them, they share a stretch.
STRINGS = "bucket int, packed binary, least long, largest long, h int, start int"
_STRINGS = pa.schema([("bucket", pa.int32()), ("packed", pa.binary()), ("least", pa.int64()), ("largest", pa.int64()), ("h", pa.int32()),
                      ("start", pa.int32())])


def packed_strings(rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """Strings of all documents, all of one bucket in one partition, travelling in compressed blocks."""
    count = partitions(rows)
    shipped = rows.sparkSession.sparkContext.broadcast(hot)
    schema = pa.schema([("part", pa.int32()), ("block", pa.binary())])

    def blocks(tables: list[tuple[np.ndarray, pa.Table]]) -> Iterator[pa.RecordBatch]:
        parts, table = np.concatenate([p for p, _ in tables]), pa.concat_tables(t for _, t in tables)
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))
        order = np.argsort(parts, kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        cuts = np.searchsorted(parts[order], np.arange(count + 1))
        for part in np.flatnonzero(np.diff(cuts)):
            some = table.slice(cuts[part], cuts[part + 1] - cuts[part])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _STRINGS, options=options) as out:
                out.write_table(merged_places(some))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=schema)

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            for texts, ids, h in _text_slices(batch, "ord", "h"):
                words = Words(texts)
                first, counts, buckets, lone = strings(words, shipped.value)
                owner = np.searchsorted(words.bounds, first, side="right") - 1
                packed = words.cut(first, first + counts + WINDOW - 2)
                ord_ = pa.array(ids.to_numpy()[owner])
                places = pa.array((first - words.bounds[owner]).astype(np.int32), mask=lone)
                held.append(((buckets % np.uint64(count)).astype(np.int32), pa.table([
                    pa.array((buckets >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(packed, pa.binary()), ord_, ord_,
                    pa.array(h.to_numpy()[owner], mask=lone), places], schema=_STRINGS)))
                size += sum(map(len, packed))
                if size > BLOCK_BYTES:
                    yield from blocks(held)
                    held, size = [], 0
        if held:
            yield from blocks(held)

    def unpack(batches):
        for batch in batches:
            for block in batch.column("block"):
                for part in pa.ipc.open_stream(block.as_buffer()):
                    for a in range(0, len(part), 10_000):
                        yield part.slice(a, 10_000)

    dealt = ship(rows.select("ord", "h", "text")).mapInArrow(pack, "part int, block binary").repartitionById(count, F.col("part"))
    return dealt.select("block").mapInArrow(unpack, STRINGS)


def merged_places(table: pa.Table) -> pa.Table:
    """Rows without a place, merged where their strings are equal; the others as they are."""
    lone = table["start"].is_null()
    if not pc.any(lone).as_py():
        return table
    again = table.filter(lone).group_by("packed").aggregate([("bucket", "min"), ("least", "min"), ("largest", "max")])
    none = pa.nulls(len(again), pa.int32())
    again = pa.table([again["bucket_min"], again["packed"], again["least_min"], again["largest_max"], none, none], schema=_STRINGS)
    return pa.concat_tables([table.filter(pc.invert(lone)), again]).combine_chunks()


def first_documents(packed: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the strings, one after another: its first document; and the bounds of the strings among the windows."""
    words = Words(packed)
    places = words.places()
    counts = np.maximum(np.diff(words.bounds) - WINDOW + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    firsts = np.repeat(least, counts)
    hashes = words.grams(WINDOW)[places]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    twice = np.sort(order[np.concatenate([[False], same]) | np.concatenate([same, [False]])])
    if len(twice):
        texts = words.cut(places[twice], places[twice] + WINDOW - 1)
        groups = pa.array(texts, pa.binary()).dictionary_encode().indices.to_numpy()
        order = np.argsort(groups, kind="stable")
        starts = np.flatnonzero(np.diff(groups[order], prepend=-1))
        earliest = np.minimum.reduceat(firsts[twice][order], starts)
        firsts[twice] = earliest[groups]
    return firsts, bounds


def found_marks(strings_: DataFrame) -> DataFrame:
    """Marks (ord, h, marks) of strings with a place, and digest and firsts of merged windows that start in two documents."""
    schema = pa.schema([("ord", pa.int64()), ("h", pa.int32()), ("marks", pa.list_(pa.int32())), ("digest", pa.binary()), ("firsts", pa.list_(pa.int64()))])

    def tell(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        own = table.group_by("packed").aggregate([("least", "min"), ("largest", "max")])
        packed = own["packed"].to_pylist()
        firsts, bounds = first_documents(packed, own["least_min"].to_numpy())
        earliest = np.minimum.reduceat(firsts, bounds[:-1])
        number = dict(zip(packed, range(len(packed))))
        shared = earliest < own["largest_max"].to_numpy()
        names = np.fromiter(map(number.__getitem__, table["packed"].to_pylist()), np.int64, len(table))
        largest = table["largest"].to_numpy()
        wanted = np.flatnonzero(shared[names] & (earliest[names] < largest))
        lone = table["start"].is_null().to_numpy()[wanted]
        starts, hashes = table["start"].fill_null(0).to_numpy(), table["h"].fill_null(0).to_numpy()
        for a in range(0, len(wanted), 4096):
            some, merged = wanted[a:a + 4096], lone[a:a + 4096]
            seen = [firsts[bounds[k]:bounds[k + 1]] for k in names[some]]
            marks = [None if m else np.flatnonzero(f < largest[i]).astype(np.int32) + starts[i] for i, m, f in zip(some, merged, seen)]
            yield pa.RecordBatch.from_arrays([
                pa.array(largest[some], mask=merged), pa.array(hashes[some], mask=merged), pa.array(marks, schema.field("marks").type),
                pa.array([xxhash.xxh3_128_digest(packed[k]) if m else None for k, m in zip(names[some], merged)], pa.binary()),
                pa.array([f if m else None for f, m in zip(seen, merged)], schema.field("firsts").type)], schema=schema)

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)]
            bytes_before = np.concatenate([[0], np.cumsum(binary_sizes(batch.column("packed")))])
            start = 0
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if last is not None and buckets[a] != last and size > SORT_BYTES:
                    if a > start:
                        held.append(batch.slice(start, a - start))
                    yield from tell(held)
                    held, size, start = [], 0, a
                size += int(bytes_before[b] - bytes_before[a])
                last = buckets[a]
            if len(buckets):
                held.append(batch.slice(start))
        if held:
            yield from tell(held)

    return strings_.sortWithinPartitions("bucket").mapInArrow(run, "ord long, h int, marks array<int>, digest binary, firsts array<long>")


def hot_places(rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """ord, h, start and digest of every window with a hot minimiser; start counts the document's words from 0."""
    schema = pa.schema([("ord", pa.int64()), ("h", pa.int32()), ("start", pa.int32()), ("digest", pa.binary())])
    shipped = rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        for batch in batches:
            for texts, ids, h in _text_slices(batch, "ord", "h"):
                words = Words(texts)
                first, _, _, lone = strings(words, shipped.value)
                first = first[lone]
                owner = np.searchsorted(words.bounds, first, side="right") - 1
                digests = list(map(xxhash.xxh3_128_digest, words.cut(first, first + WINDOW - 1)))
                out = pa.RecordBatch.from_arrays([
                    pa.array(ids.to_numpy()[owner]), pa.array(h.to_numpy()[owner]),
                    pa.array((first - words.bounds[owner]).astype(np.int32)), pa.array(digests, pa.binary())], schema=schema)
                for a in range(0, len(out), 10_000):
                    yield out.slice(a, 10_000)

    return ship(rows.select("ord", "h", "text")).mapInArrow(run, "ord long, h int, start int, digest binary")


def marked_places(docs: DataFrame, hot_strings: int | None = None) -> DataFrame:
    """ord, h, marks: by document the first words of all windows that start in a document of smaller id."""
    rows = keyed(docs)
    hot = hot_minimisers(rows, hot_strings)
    found = cut_lineage(found_marks(packed_strings(rows, hot)))
    marks = found.where(F.col("marks").isNotNull()).select("ord", "h", "marks")
    if len(hot):
        # Blocks of several tasks tell of the same window; each has its least document by then.
        shared = found.where(F.col("digest").isNotNull()).select("digest", F.element_at("firsts", 1).alias("first")).distinct()
        places = hot_places(rows, hot).join(shared, "digest").where(F.col("first") < F.col("ord"))
        marks = marks.unionByName(places.select("ord", "h", F.array("start").alias("marks")))
    return marks.groupBy("ord", "h").agg(F.flatten(F.collect_list("marks")).alias("marks"))


def kept_words(text: str | None, marks: np.ndarray) -> tuple[int, list[bytes]]:
    """Number of words of a text, and those no marked window covers."""
    words = (text or "").encode().split()
    if not len(marks):
        return len(words), words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, marks, 1)
    np.add.at(change, marks + WINDOW, -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return len(words), [words[i] for i in kept.tolist()]


def dedup_substrings(docs: DataFrame, hot_strings: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, one blank between them) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = keyed(docs)
    marks = cut_lineage(marked_places(docs, hot_strings))
    out = f"doc_id {kind}, n_words long, n_removed long, kept string"
    joined = rows.join(marks, ["ord", "h"], "left").select("doc_id", "text", "marks")
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], out).schema)
    none = np.zeros(0, np.int64)

    def run(batches):
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, places in zip(batch.column("text"), batch.column("marks")):
                n, words = kept_words(text.as_py(), places.values.to_numpy().astype(np.int64) if places.is_valid else none)
                counts.append(n)
                removed.append(n - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(schema.field(0).type), pa.array(counts, pa.int64()),
                                              pa.array(removed, pa.int64()), pa.array(kept, schema.field(3).type)], schema=schema)

    return ship(joined).mapInArrow(run, out)
