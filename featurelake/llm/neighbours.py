"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

Vectors get one more component that lifts all to the largest norm, so the largest inner product with a query (scaled to
that norm) is the least distance. ``TABLES`` tables hash a vector by k random projections cut into cells of one width;
k grows with the logarithm of the number of vectors, so a bucket's population does not. A query visits buckets in order
of estimated success: the chance that a neighbour at its distance ``near`` falls into each cell, the product over the
projections, explored best first until the visited chances add up to ``SUCCESS`` in every table. All candidates of all
tables are merged and reranked by the exact inner product of the original vectors in double precision.

Each query's ``near`` is its own, estimated on a bounded sample (``SAMPLE`` vectors); every vector is indexed. Where the
sample's distances lie far apart, as with groups of near copies among lone vectors, there are tables with cells of up to
``SCALES`` widths, and a query uses those next to its distance.

No query ends by the estimate alone. The cells it visited are weighed again at the distance of the last answer found,
which the true one cannot exceed. A query with too few answers, or whose chance there is more than ``SLACK`` below the
one aimed at, is compared with all vectors in blocks, so its answer is exact.
On vectors without near neighbours, such as evenly spread directions, the recall aimed at makes a query visit most buckets.

Equal vectors are one node with its least ids, for queries and candidates alike: only the ``top`` + 1 least ids of equal
vectors can be in any answer, so this loses nothing. Buckets above ``PIECE`` rows are cut into pieces that each query
of the bucket visits. A task holds one piece of vectors and one of queries, and passes on each query's best alone.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part, neither as
query nor as candidate. Only vectors of equal length are compared. Ties go to the smaller id. Rows with a null id take
no part; rows of equal id and vector count once. Fewer candidates give a shorter answer. Extra columns are left out.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurelake.llm.common import arrow_map, partitions, ship
from featurelake.llm.components import whole_groups
from featurelake.session import cut_lineage

#: Tables, estimated success in each, width of a cell in units of the neighbours' distance, vectors per bucket aimed at.
TABLES, SUCCESS, WIDTH, POPULATION = 2, 0.78, 1.4, 256
#: Vectors of the sample, cells looked at on each side of a query's own, rows of a piece of a bucket.
SAMPLE, REACH, PIECE = 4096, 2, 4096
#: Most widths of cells, ratio of distances that one width serves, chance that a finished query may fall short by.
SCALES, SPREAD, SLACK = 4, 2.0, 0.05
#: Queries whose distances from the sample are held at a time.
QUERIES_AT_ONCE = 256


def usable(vector: Column) -> Column:
    sound = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """uid (the least id), ids (the ``keep`` least) and embedding of each distinct vector of rows vec_id, embedding."""

    def shorten(batch):
        ids = batch.column("vec_id").to_pylist()
        groups: dict = {}
        for i, vector in enumerate(batch.column("embedding")):
            groups.setdefault(vector.values.to_numpy().tobytes(), []).append(i)
        yield {"ids": [sorted({ids[i] for i in g})[:keep] for g in groups.values()],
               "embedding": batch.column("embedding").take([g[0] for g in groups.values()])}

    # Zero and minus zero are one value to the grouping, so make them one here as well.
    even = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("embedding"))
    parts = arrow_map(even, shorten, "ids array<long>, embedding array<double>")
    grouped = parts.groupBy("embedding").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    ids = F.slice(F.array_sort(F.array_distinct("ids")), 1, keep)
    return grouped.select(F.element_at(ids, 1).alias("uid"), ids.alias("ids"), F.size("embedding").alias("dim"), "embedding")


class Tables:
    """Projections for one length of vectors."""

    def __init__(self, dim: int, count: int, norm: float, near: float, tables: int, success: float) -> None:
        self.norm, self.near, self.success = norm, near, success
        self.width = WIDTH * near
        self.k = max(2, round(math.log(max(count, 1) / POPULATION, 4))) if count > POPULATION else 2
        random = np.random.default_rng(dim)
        self.axes = random.normal(size=(tables, self.k, dim + 1))
        self.shift = random.uniform(0, self.width, (tables, self.k))
        self.place = random.integers(1, 2**62, (tables, self.k + 1), dtype=np.int64)

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.norm**2 - (vectors**2).sum(axis=1), 0)
        return np.concatenate([vectors, np.sqrt(rest)[:, None]], axis=1)

    def scaled(self, queries: np.ndarray) -> np.ndarray:
        """Queries brought to the common norm, with nothing in the added component."""
        size = np.sqrt((queries**2).sum(axis=1))[:, None]
        return np.concatenate([queries / size * self.norm, np.zeros((len(queries), 1))], axis=1)

    def cells(self, table: int, points: np.ndarray) -> np.ndarray:
        return (points @ self.axes[table].T + self.shift[table]) / self.width

    def code(self, table: int, cells: np.ndarray) -> np.ndarray:
        return (cells.astype(np.int64) * self.place[table, :-1]).sum(axis=1) + self.place[table, -1]

    def chances(self, cell: np.ndarray, near: float) -> np.ndarray:
        """By projection and offset of a cell from the query's own: chance that a neighbour at distance near lies there."""
        edges = (np.arange(-REACH, REACH + 2)[None, :] - (cell - np.floor(cell))[:, None]) * self.width / near
        return np.diff(0.5 * (1 + np.vectorize(math.erf)(edges / math.sqrt(2))), axis=1)

    def probes(self, cell: np.ndarray, near: float) -> np.ndarray:
        """Offsets of the cells to visit for one query, likeliest first, until their chances add up to the success aimed at.

        Each projection's offsets are ordered by the chance that a neighbour lies there; best-first search over the
        offsets' ranks yields their products in falling order.
        """
        offsets = np.arange(-REACH, REACH + 1)
        chance = self.chances(cell, near)
        order = np.argsort(-chance, axis=1, kind="stable")
        cost = -np.log(np.maximum(np.take_along_axis(chance, order, 1), 1e-300))
        rows, costs = range(self.k), cost.tolist()
        start = (0,) * self.k
        heap, total, found, seen = [(sum(c[0] for c in costs), start)], 0.0, [], {start}
        while heap and total < self.success:
            spent, ranks = heapq.heappop(heap)
            total += math.exp(-spent)
            found.append(ranks)
            for i in rows:
                if ranks[i] + 1 < len(offsets):
                    after = (*ranks[:i], ranks[i] + 1, *ranks[i + 1:])
                    if after not in seen:
                        seen.add(after)
                        heapq.heappush(heap, (spent + costs[i][ranks[i] + 1] - costs[i][ranks[i]], after))
        ranks = np.array(found)
        return offsets[np.take_along_axis(order, ranks.T, 1).T]

    def covered(self, cell: np.ndarray, visited: np.ndarray, near: float) -> float:
        """Chance that a neighbour at distance near lies in one of the visited cells (offsets)."""
        chance = self.chances(cell, near)
        return float(chance[np.arange(self.k), visited + REACH].prod(axis=1).sum())


@dataclass
class Plan:
    """Tables of every width for one length of vectors, and the sample that a query's distance is estimated on."""

    scales: list[Tables]
    sample: np.ndarray
    rank: int

    def nears(self, queries: np.ndarray) -> np.ndarray:
        """Estimated distance of each query's neighbours."""
        if len(self.sample) < 2:
            return np.full(len(queries), self.scales[0].near)
        return distances(self.scales[0], self.sample, queries, self.rank)

    def scale(self, near: float) -> int:
        return int(np.argmin([abs(math.log(t.near / near)) for t in self.scales]))

    def visits(self, query: np.ndarray, near: float):
        """Scale, table, cell and offsets of the cells visited for a query."""
        s = self.scale(near)
        tables = self.scales[s]
        for t in range(len(tables.axes)):
            cell = tables.cells(t, tables.scaled(query[None, :]))[0]
            yield s, t, cell, tables.probes(cell, min(near, SPREAD * tables.near))


def distances(plain: Tables, sample: np.ndarray, queries: np.ndarray, rank: int) -> np.ndarray:
    """Distance of each query from the ``rank``-th nearest of the sample, vectors equal to it left out."""
    out, points = np.empty(len(queries)), plain.lifted(sample)
    whole = np.ascontiguousarray(sample).view(np.dtype((np.void, sample.itemsize * sample.shape[1])))[:, 0]
    for a in range(0, len(queries), QUERIES_AT_ONCE):
        part = np.ascontiguousarray(queries[a:a + QUERIES_AT_ONCE])
        apart = 2 * plain.norm**2 - 2 * plain.scaled(part) @ points.T
        for i, key in enumerate(part.view(whole.dtype)[:, 0]):
            apart[i, whole == key] = np.inf
        out[a:a + len(part)] = np.partition(apart, rank - 1, axis=1)[:, rank - 1]
    return np.sqrt(np.maximum(np.where(np.isfinite(out), out, 2 * plain.norm**2), 1e-12 * plain.norm**2))


def widths(nears: np.ndarray) -> list[float]:
    """Distances that the cells' widths are made for: the median, then that of the distances no width serves yet."""
    out, rest = [], nears
    while len(out) < SCALES and len(rest) and (not out or len(rest) > len(nears) / 100):
        out.append(float(np.sort(rest)[len(rest) // 2]))
        rest = rest[(rest < out[-1] / SPREAD) | (rest > out[-1] * SPREAD)]
    return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, dim)


def plan_tables(nodes: DataFrame, top: int, tables: int, success: float) -> dict[int, Plan]:
    """Projections by length of vectors, from counts and norms of all vectors and distances in the sample."""
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    known = nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(square)).alias("norm")).collect()
    out = {}
    for row in known:  # one row per length of vectors
        dim, n, norm = row["dim"], row["n"], row["norm"] or 1.0
        share = min(1.0, SAMPLE / n)
        place = F.pmod(F.xxhash64("uid"), F.lit(1 << 30)) / float(1 << 30)
        found = nodes.filter((F.col("dim") == dim) & (place < share)).select("uid", "embedding").limit(2 * SAMPLE).toArrow()
        sample, rank, nears = np.zeros((0, dim)), 1, [norm]
        if found.num_rows > 1:
            sample = matrix(found.column("embedding").combine_chunks(), dim)
            rank = min(len(sample) - 1, max(1, round(top * len(sample) / n)))
            nears = widths(distances(Tables(dim, n, norm, 1.0, 1, success), sample, sample[:512], rank))
        out[dim] = Plan([Tables(dim, n, norm, near, tables, success) for near in nears], sample, rank)
    return out


def cut_buckets(entries: DataFrame, probes: DataFrame, piece: int) -> DataFrame:
    """Entries and probes of each bucket as parts of at most about ``piece`` entries and ``piece`` probes; every probe
    meets every entry of its bucket in exactly one part."""
    keys = ["dim", "tab", "code"]

    def large(rows: DataFrame, name: str) -> DataFrame:
        return (rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > piece)
                .select(*keys, F.ceil(F.col("n") / piece).cast("int").alias(name)))

    many = cut_lineage(large(entries, "of_entries").join(large(probes, "of_probes"), keys, "full"))
    if many.isEmpty():
        whole = {"piece_a": F.lit(0), "piece_b": F.lit(0)}
        return entries.withColumns(whole).unionByName(probes.withColumns(whole))
    sized = [r.join(many, keys, "left").fillna(1, ["of_entries", "of_probes"]) for r in (entries, probes)]
    own = F.pmod(F.xxhash64("uid"), F.lit(1 << 30))
    parts = [sized[0].withColumn("piece_a", (own % F.col("of_entries")).cast("int"))
             .withColumn("piece_b", F.explode(F.sequence(F.lit(0), F.col("of_probes") - 1))),
             sized[1].withColumn("piece_b", (own % F.col("of_probes")).cast("int"))
             .withColumn("piece_a", F.explode(F.sequence(F.lit(0), F.col("of_entries") - 1)))]
    return parts[0].unionByName(parts[1]).drop("of_entries", "of_probes")


def best_of(scores: np.ndarray, uids: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores of a row, ties to smaller ids."""
    if len(scores) > top:
        least = np.partition(scores, len(scores) - top)[len(scores) - top]
        places = np.flatnonzero(scores >= least - 1e-12 * abs(least))
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((uids[places], -scores[places]))][:top]


def nearest(vectors: DataFrame, is_query: Column, top: int = 20, tables: int = TABLES, success: float = SUCCESS,
            piece: int = PIECE) -> DataFrame:
    """query_id, rank, vec_id and score of the ``top`` found for each row (vec_id, embedding) with ``is_query``."""
    sound = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    nodes = cut_lineage(distinct_vectors(sound.select("vec_id", "embedding"), top + 1))
    asked = cut_lineage(distinct_vectors(sound.filter(is_query).select("vec_id", "embedding"), 1).select("uid", "dim", "embedding"))
    plans = vectors.sparkSession.sparkContext.broadcast(plan_tables(nodes, top, tables, success))

    def hashed(batch):
        for dim in set(batch.column("dim").to_pylist()):
            part = batch.filter(pa.compute.equal(batch.column("dim"), dim))
            values = matrix(part.column("embedding"), dim)
            for s, plan in enumerate(plans.value[dim].scales):
                points = plan.lifted(values)
                for t in range(tables):
                    yield {"dim": part.column("dim"), "tab": [s * tables + t] * part.num_rows, "probe": [False] * part.num_rows,
                           "code": plan.code(t, np.floor(plan.cells(t, points))), "uid": part.column("uid"), "embedding": part.column("embedding")}

    def estimated(batch):
        """Each query of a batch: its place, plan, vector and estimated distance."""
        for dim in set(batch.column("dim").to_pylist()):
            places = np.flatnonzero(batch.column("dim").to_numpy() == dim)
            values = matrix(batch.column("embedding").take(pa.array(places)), dim)
            yield from zip(places, [plans.value[dim]] * len(places), values, plans.value[dim].nears(values))

    def probing(batch):
        for i, plan, vector, near in estimated(batch):
            for s, t, cell, visited in plan.visits(vector, near):
                codes = plan.scales[s].code(t, np.floor(cell) + visited)
                row = batch.slice(i, 1)
                yield {"tab": [s * tables + t] * len(codes), "probe": [True] * len(codes), "code": codes} | {
                    c: row.column(c).take([0] * len(codes)) for c in ("dim", "uid", "embedding")}

    def unfinished(batch):
        """Queries with too few answers, or whose cells do not cover the distance of the last one."""
        keep = []
        for i, plan, vector, near in estimated(batch):
            last = batch.column("last")[i].as_py()
            missed = 1.0
            if last is not None:
                norm = plan.scales[0].norm
                reached = math.sqrt(max(2 * norm**2 - 2 * norm * last / math.sqrt((vector**2).sum()), 1e-12 * norm**2))
                for s, t, cell, visited in plan.visits(vector, near):
                    missed *= 1 - min(1.0, plan.scales[s].covered(cell, visited, reached))
            if missed > (1 - success)**tables + SLACK:
                keep.append(i)
        yield {c: batch.column(c).take(pa.array(keep, pa.int64())) for c in ("uid", "dim", "embedding")}

    shape = "dim int, tab int, probe boolean, code long, uid long, embedding array<double>"
    entries, probes = arrow_map(nodes.select("dim", "uid", "embedding"), hashed, shape), arrow_map(asked, probing, shape)
    keys = ["dim", "tab", "code", "piece_a", "piece_b"]
    kinds = pa.schema([("query", pa.int64()), ("uid", pa.int64()), ("score", pa.float64())])

    def search(batches):
        for table, starts in whole_groups(batches, keys, 1 << 15):
            table = table.combine_chunks()
            uids, probe, dims = (table.column(c).to_numpy() for c in ("uid", "probe", "dim"))
            found: dict[int, list] = {}
            for a, b in zip(starts, starts[1:]):
                split = a + int((~probe[a:b]).sum())
                if a < split < b:
                    values = matrix(table.column("embedding").slice(a, b - a).combine_chunks(), int(dims[a]))
                    own, queries = values[:split - a], values[split - a:]
                    scores = queries @ own.T
                    for i in range(len(queries)):
                        places = best_of(scores[i], uids[a:split], top + 1)
                        exact = (own[places] * queries[i]).sum(axis=1)
                        found.setdefault(int(uids[split + i]), []).append((uids[a:split][places], exact))
            for query, lists in found.items():
                ids, scores = (np.concatenate([x[k] for x in lists]) for k in (0, 1))
                ids, first = np.unique(ids, return_index=True)
                places = best_of(scores[first], ids, top + 1)
                found[query] = [(ids[places], scores[first][places])]
            sizes = [len(x[0][0]) for x in found.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(list(found), np.int64), sizes)),
                 pa.array(np.concatenate([x[0][0] for x in found.values()]) if found else np.zeros(0, np.int64)),
                 pa.array(np.concatenate([x[0][1] for x in found.values()]) if found else np.zeros(0))], schema=kinds)

    def answered(entries, probes):
        """query and the ``top`` + 1 best it finds in the buckets it probes."""
        parts = cut_buckets(entries, probes, piece)
        together = parts.repartition(partitions(vectors), *keys).sortWithinPartitions(*keys, "probe")
        merged = (ship(together).mapInArrow(search, "query long, uid long, score double")
                  .groupBy("query", "uid").agg(F.max("score").alias("score")))
        order = Window.partitionBy("query").orderBy(F.desc("score"), "uid")
        best = merged.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top + 1)
        return (best.join(nodes.select("uid", "ids"), "uid").select("query", "score", F.explode("ids").alias("vec_id"))
                .withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
                .filter(F.col("r") <= top + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found")))

    listed = cut_lineage(answered(entries, probes))
    last = listed.select(F.col("query").alias("uid"), F.when(F.size("found") > top, F.element_at("found", -1)["score"]).alias("last"))
    rest = cut_lineage(arrow_map(asked.join(last, "uid", "left").select("uid", "dim", "embedding", "last"), unfinished,
                                 "uid long, dim int, embedding array<double>"))
    if not rest.isEmpty():
        # One bucket holds all vectors of a length, and is cut like any other.
        whole = [rows.select("dim", F.lit(-1).alias("tab"), F.lit(probe).alias("probe"), F.lit(0).cast("long").alias("code"), "uid", "embedding")
                 for rows, probe in ((nodes, False), (rest, True))]
        listed = (listed.join(rest.select(F.col("uid").alias("query")), "query", "left_anti")
                  .unionByName(answered(*whole)))
    # Each query id takes its vector's list without itself.
    everyone = sound.filter(is_query).select(F.col("vec_id").cast("long").alias("query_id"),
                                             F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("embedding")).distinct()
    owners = everyone.join(asked.select(F.col("uid").alias("query"), "embedding"), "embedding").select("query_id", "query")
    answers = owners.join(listed, "query").select("query_id", F.filter("found", lambda x: x["vec_id"] != F.col("query_id")).alias("found"))
    return (answers.select("query_id", F.posexplode(F.slice("found", 1, top)).alias("at", "x"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")))
