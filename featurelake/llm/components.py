"""Connected components of a graph too large for one machine, and the pieces its edges are found in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelake.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of the edges (columns a and b, of one type).

    Distributed union-find by alternating stars: the larger end of each edge is hung on the least neighbour of the
    smaller end, then all smaller neighbours of a node on the least of them. Each round is two equi-joins against one
    row per node, so adaptive execution can split a node that many edges meet in, and its result is a table in the
    shared folder. The number of rounds grows with the logarithm of a component's width. No edge passes the driver.
    """
    ends = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    current = cut_lineage(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = state(current)
    while seen[0]:
        least = current.groupBy("u").agg(F.min("v").alias("m"))
        hung = (current.join(least.withColumnRenamed("u", "v"), "v", "left")
                .select("u", F.coalesce("m", "v").alias("v")).distinct())
        below = hung.join(hung.groupBy("u").agg(F.min("v").alias("m")), "u")
        # Each row gives its node's link to the least, and its other end's.
        pairs = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        following = cut_lineage(below.select(F.explode(pairs).alias("e")).select("e.u", "e.v").filter("u <> v").distinct())
        now = state(following)
        current = following
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def state(edges: DataFrame) -> tuple:
    """Number and combined hash of the rows, equal only when nothing changed."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def hook(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i] in place; labels point to the least member of each set."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``rows`` rows that end where a group ends, with the starts of the groups and the number of rows.

    The batches must be sorted by the keys, which are whole numbers without nulls.
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            values = table.column(k).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held)
            cut = starts(table)
            if len(cut) > 1:
                yield table.slice(0, cut[-1]), cut
                table = table.slice(cut[-1])
            held, size = table.to_batches(), table.num_rows
    if size:
        table = pa.Table.from_batches(held)
        yield table, np.concatenate([starts(table), [size]])


def bounded_groups(rows: DataFrame, keys: list[str], spread: str, limit: int) -> DataFrame:
    """The rows with columns piece_a and piece_b, so that rows agreeing in keys and both pieces are at most about twice
    ``limit``, and any two rows of one group meet in at least one such part.

    A group of more than ``limit`` rows is cut into pieces by the hash of ``spread``, and each piece goes to its pairing
    with every other. Smaller groups stay whole and are not copied.
    """
    large = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
                        .withColumn("pieces", F.ceil(F.col("n") / limit).cast("int")).drop("n"))
    if large.isEmpty():
        return rows.withColumns({"piece_a": F.lit(0), "piece_b": F.lit(0)})
    own = F.pmod(F.xxhash64(spread), F.col("pieces")).cast("int")
    joined = rows.join(large, keys, "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn("own", own)
    other = joined.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return other.select(*rows.columns, F.least("own", "other").alias("piece_a"), F.greatest("own", "other").alias("piece_b"))
