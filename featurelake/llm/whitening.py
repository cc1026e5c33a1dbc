"""Embedding whitening: rows projected on the leading principal components, each of variance one.

Entries become whole numbers (``SCALE`` cells a unit), and each distinct whole vector counts once in the fit. Sums are exact
whole numbers; the covariance is summed over centred vectors, one matrix a task, and those are added row by row in Spark.
One task per vector length then finds the leading components:

- Householder reflections bring the matrix to tridiagonal form,
- bisection on the Sturm count encloses each of the leading eigenvalues,
- inverse iteration gives their vectors; those of eigenvalues close to each other are made orthogonal at each step,
- the reflections, in reverse, carry the vectors back.

Rows are projected by a broadcast model: sums, means and components of every vector length. There are at most as many
lengths as the longest vector has entries, so the model is no larger than a few covariance matrices, however many rows.

Defined results: vectors that are null, or hold a null or non-finite entry, are dropped. An empty vector has no components
and so gives no rows. Vectors of different length are fitted apart. Entries beyond a long after scaling become the nearest
long. Rows of equal id, null ids included, are all returned. A component without variance (fewer distinct vectors than
components, constant entries) has whitened null and counts in neither the error nor, beyond its zero share, the rest;
``explained`` is null where the trace is zero, ``identity_error`` where no component has variance. ``deviation`` is null
where the exact sum exceeds a long. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelake.llm.common import partitions, ship
from featurelake.session import cut_lineage

#: Whole-number cells of one unit, and components asked for.
SCALE, COMPONENTS = 256, 4
#: Matrix cells that a task holds before it passes them on, rows projected at a time.
CELLS, ROWS = 1 << 24, 2048
_EPS, _LONG = float(np.finfo(float).eps), 2**63 - 1


def usable(vector: Column) -> Column:
    """The vector and all its entries are there and finite."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * entry) of every entry as a long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def whole_rows(df: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    return df.where(usable(F.col(vector))).select(F.col(key).alias("id"), whole(F.col(vector), scale).alias("x"))


# -- leading eigenpairs of a symmetric matrix ---------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit reflection vectors (their leading zeros left out)."""
    a = np.array(matrix, dtype=float)
    d = len(a)
    reflections = []
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        size = np.abs(x).max()
        v = x / size if size else x
        length = np.sqrt(v @ v)
        v[0] += length if v[0] >= 0 else -length
        norm = np.sqrt(v @ v)
        if norm:
            v /= norm
            block = a[k + 1:, k + 1:]
            p = block @ v
            w = 2 * (p - (v @ p) * v)
            block -= np.outer(v, w) + np.outer(w, v)
            rest = x - 2 * (v @ x) * v
            a[k + 1:, k] = a[k, k + 1:] = 0
            a[k + 1, k] = a[k, k + 1] = rest[0]
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def below(diagonal: np.ndarray, squares: np.ndarray, points: np.ndarray, least: float) -> np.ndarray:
    """Sturm count: number of eigenvalues below each point, from the signs of the pivots of T - point."""
    pivot = diagonal[0] - points
    found = (pivot < 0).astype(int)
    for value, square in zip(diagonal[1:], squares):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        pivot = value - points - square / pivot
        found += pivot < 0
    return found


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The largest eigenvalues, falling, each halved into an interval of rounding width."""
    reach = np.zeros(len(diagonal))
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    top, bottom = (diagonal + reach).max(), (diagonal - reach).min()
    size = max(abs(top), abs(bottom))
    slack = 2 * _EPS * size + np.finfo(float).tiny
    low, high = np.full(count, bottom - slack), np.full(count, top + slack)
    squares, least = off**2, max(np.finfo(float).tiny * 4, _EPS * _EPS * size)
    wanted = len(diagonal) - np.arange(1, count + 1)  # eigenvalues below the one sought
    for _ in range(1100):
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high) | (high - low <= _EPS * np.abs(middle))):
            break
        fewer = below(diagonal, squares, middle, least) <= wanted
        low, high = np.where(fewer, middle, low), np.where(fewer, high, middle)
    return low + (high - low) / 2


def shifted_factors(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float) -> list[tuple]:
    """Gaussian elimination with row exchanges of T - shift: per row the pivot, two entries right of it, factor, exchanged."""
    d = len(diagonal)
    rows = []
    a, b = diagonal[0] - shift, off[0] if d > 1 else 0.0
    for i in range(d - 1):
        under, c, e = off[i], diagonal[i + 1] - shift, off[i + 1] if i + 2 < d else 0.0
        if abs(under) > abs(a):
            factor = a / under
            rows.append((under, c, e, factor, True))
            a, b = b - factor * c, -factor * e
        else:
            a = a if abs(a) >= least else least
            factor = under / a
            rows.append((a, b, 0.0, factor, False))
            a, b = c - factor * b, e
    rows.append((a if abs(a) >= least else least, 0.0, 0.0, 0.0, False))
    return rows


def solved(factors: list[tuple], right: np.ndarray) -> np.ndarray:
    y = right.tolist()
    d = len(y)
    for i in range(d - 1):
        if factors[i][4]:
            y[i], y[i + 1] = y[i + 1], y[i]
        y[i + 1] -= factors[i][3] * y[i]
    for i in range(d - 1, -1, -1):
        pivot, one, two = factors[i][:3]
        y[i] = (y[i] - (one * y[i + 1] if i + 1 < d else 0.0) - (two * y[i + 2] if i + 2 < d else 0.0)) / pivot
        if abs(y[i]) > 1e200:
            big = abs(y[i])
            y = [v / big for v in y]
    return np.array(y)


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors of the eigenvalues by inverse iteration, orthogonal within clusters of close eigenvalues."""
    d = len(diagonal)
    size = np.abs(diagonal).max() + (2 * np.abs(off).max() if d > 1 else 0.0)
    least = max(_EPS * size, np.finfo(float).tiny * 4)
    random = np.random.default_rng(d)
    found, cluster, last = [], [], None
    for value in values:
        shift = value
        if last is None or last - value > 1e-3 * size:
            cluster = []
        elif last - shift < 10 * _EPS * size:
            shift = last - 10 * _EPS * size  # equal eigenvalues need different shifts
        factors = shifted_factors(diagonal, off, shift, least)
        x = random.uniform(-1, 1, d)
        for _ in range(6):
            x /= np.abs(x).max()
            x = solved(factors, x)
            x /= np.abs(x).max()
            for _ in range(2):
                for other in cluster:
                    x -= (other @ x) * other
            norm = np.sqrt(x @ x)
            x = x / norm if norm > 0 else random.uniform(-1, 1, d)
        x /= np.sqrt(x @ x)
        found.append(x)
        cluster.append(x)
        last = shift
    return np.array(found)


def leading_pairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit vectors as rows."""
    count = min(count, len(matrix))
    if count == 0:
        return np.zeros(0), np.zeros((0, len(matrix)))
    size = np.abs(matrix).max()
    if size == 0:
        return np.zeros(count), np.eye(count, len(matrix))
    scaled = matrix / size
    diagonal, off, reflections = tridiagonal(scaled)
    vectors = tridiagonal_vectors(diagonal, off, leading_values(diagonal, off, count))
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        vectors[:, k + 1:] -= 2 * np.outer(vectors[:, k + 1:] @ v, v)
    vectors /= np.sqrt((vectors**2).sum(axis=1))[:, None]
    values = ((vectors @ scaled) * vectors).sum(axis=1)  # Rayleigh quotients
    order = np.argsort(-values, kind="stable")
    return values[order] * size, vectors[order]


# -- sums over tasks ----------------------------------------------------------------------------------


def matrices(batch: pa.RecordBatch, column: str = "x") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and whole vectors of each length in a batch, a bounded number of rows at a time."""
    lists = batch.column(column)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.values.to_numpy(zero_copy_only=False)
    starts = np.asarray(lists.offsets)[:-1]
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        for at in range(0, len(rows), ROWS):
            some = rows[at:at + ROWS]
            yield some, values[starts[some][:, None] + np.arange(d)]


def totals(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Per length: number of vectors and the exact sums of their entries."""
    schema = pa.schema([("d", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for _, x in matrices(batch):
                most = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
                sums = (x if most * len(x) < 2**62 else x.astype(object)).sum(axis=0)
                have = found.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
                have[0] += len(x)
                have[1] = have[1] + sums.astype(object)
        if found:
            yield pa.RecordBatch.from_arrays([
                pa.array(list(found), pa.int32()), pa.array([n for n, _ in found.values()], pa.int64()),
                pa.array([[Decimal(int(s)) for s in sums] for _, sums in found.values()], schema.field("sums").type)], schema=schema)

    parts = ship(fit).mapInArrow(run, "d int, n long, sums array<decimal(38,0)>")
    counts = parts.groupBy("d").agg(F.sum("n").alias("n"))
    sums = (parts.select("d", F.posexplode("sums").alias("at", "s")).groupBy("d", "at").agg(F.sum("s").cast("decimal(38,0)").alias("s"))
            .groupBy("d").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("sums")))
    # One row for each length of vectors, with one number for each entry.
    rows = counts.join(sums, "d", "left").select("d", "n", F.col("sums.s").alias("sums")).collect()
    return {r["d"]: (r["n"], [int(s) for s in r["sums"] or []]) for r in rows}


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: longs, or Python's whole numbers where longs could overflow in the sum of squares."""
    d = x.shape[1]
    most = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    bound = n * most + max(map(abs, sums), default=0)
    if d * bound * bound <= _LONG:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def covariance_rows(fit: DataFrame, stats: dict[int, tuple[int, list[int]]]) -> DataFrame:
    """Rows (d, i, values) of the covariance matrix of every length: partial matrices of tasks, added by row."""
    schema = pa.schema([("d", pa.int32()), ("i", pa.int32()), ("values", pa.list_(pa.float64()))])

    def out(found: dict) -> Iterator[pa.RecordBatch]:
        for d, m in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), d, np.int32)), pa.array(np.arange(len(m), dtype=np.int32)),
                                              pa.array(list(m), schema.field("values").type)], schema=schema)

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch):
                n, sums = stats[x.shape[1]]
                y = deviations(x, n, sums).astype(float) / n
                d = x.shape[1]
                if d not in found and sum(m.size for m in found.values()) + d * d > CELLS:
                    yield from out(found)
                    found = {}
                found[d] = found.get(d, 0.0) + (y.T @ y) / n
        yield from out(found)

    def add(batches):
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for d, i, values in zip(batch.column("d").to_pylist(), batch.column("i").to_pylist(), batch.column("values")):
                found[d, i] = found.get((d, i), 0.0) + values.values.to_numpy()
        for (d, i), values in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([i], pa.int32()),
                                              pa.array([values], schema.field("values").type)], schema=schema)

    text = "d int, i int, values array<double>"
    parts = ship(fit).mapInArrow(run, text)
    return parts.repartition(partitions(fit), "d", "i").mapInArrow(add, text)


def components_of(rows: DataFrame, count: int) -> DataFrame:
    """d, trace, eigenvalues and vectors of each covariance matrix; a matrix is bounded by the length of its vectors."""
    schema = pa.schema([("d", pa.int32()), ("trace", pa.float64()), ("eigenvalues", pa.list_(pa.float64())),
                        ("vectors", pa.list_(pa.list_(pa.float64())))])

    def solve(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("i").to_numpy())
        matrix = np.array([table.column("values")[int(i)].values.to_numpy() for i in order])
        matrix = (matrix + matrix.T) / 2
        values, vectors = leading_pairs(matrix, count)
        return pa.table([pa.array([len(matrix)], pa.int32()), pa.array([float(np.trace(matrix))]), pa.array([values.tolist()], schema.field(2).type),
                         pa.array([vectors.tolist()], schema.field(3).type)], schema=schema)

    return rows.groupBy("d").applyInArrow(solve, "d int, trace double, eigenvalues array<double>, vectors array<array<double>>")


# -- the model ----------------------------------------------------------------------------------------


class Fitted:
    """Of one length: number of distinct vectors, sums, eigenvalues, components, trace; scales are None without variance."""

    def __init__(self, n: int, sums: list[int], trace: float, values: list[float], vectors: list[list[float]]) -> None:
        self.n, self.sums, self.trace = n, sums, trace
        self.values, self.vectors = np.array(values, float), np.array(vectors, float).reshape(len(values), len(sums))
        self.sound = self.values > 64 * len(sums) * _EPS * trace
        self.projection = (self.vectors / np.sqrt(np.where(self.sound, self.values, 1.0))[:, None]).T
        self.identity_error: float | None = None

    def explained(self) -> list[float | None]:
        return [float(v / self.trace) if self.trace > 0 else None for v in self.values]

    def whitened(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whitened values, and the exact deviations n * x - S they come from."""
        away = deviations(x, self.n, self.sums)
        return away.astype(float) / self.n @ self.projection, away


def fit(df: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS, scale: int = SCALE) -> dict[int, Fitted]:
    """The model of every vector length."""
    distinct = cut_lineage(whole_rows(df, key, vector, scale).select("x").distinct())
    stats = totals(distinct)
    solved_rows = components_of(covariance_rows(distinct, stats), count).collect()
    model = {d: Fitted(n, sums, 0.0, [], []) for d, (n, sums) in stats.items()}
    for r in solved_rows:
        model[r["d"]] = Fitted(*stats[r["d"]], r["trace"], r["eigenvalues"], r["vectors"])
    for d, error in identity_errors(distinct, model, count).items():
        model[d].identity_error = error
    return model


def identity_errors(fit_list: DataFrame, model: dict[int, Fitted], count: int) -> dict[int, float]:
    """Per length the largest entry of (covariance of the whitened fit list - identity), over components with variance."""
    schema = pa.schema([("d", pa.int32()), ("w", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            for _, x in matrices(batch):
                fitted = model[x.shape[1]]
                if fitted.sound.any():
                    w = fitted.whitened(x)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), x.shape[1], np.int32)), pa.array(list(w), schema.field("w").type)],
                                                     schema=schema)

    rows = cut_lineage(ship(fit_list).mapInArrow(run, "d int, w array<double>"))
    # Beyond a length's own components get() is null, and so are their sums.
    means = rows.groupBy("d").agg(F.array(*[F.avg(F.get("w", F.lit(i))) for i in range(count)]).alias("m"))
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    away = [F.get("w", F.lit(i)) - F.get("m", F.lit(i)) for i in range(count)]
    found = rows.join(means, "d").groupBy("d").agg(*[F.avg(away[i] * away[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect()
    return {r["d"]: max(abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if j < len(model[r["d"]].sound)
                        and model[r["d"]].sound[i] and model[r["d"]].sound[j]) for r in found}


def transform(df: DataFrame, model: dict[int, Fitted], key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """key, component, n, deviation, whitened, explained and identity_error of every usable row and component."""
    spark = df.sparkSession
    shipped = spark.sparkContext.broadcast(model)
    rows = whole_rows(df, key, vector, scale)
    kind = rows.schema["id"].dataType.simpleString()
    out = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark.createDataFrame([], out).schema)

    def run(batches):
        for batch in batches:
            ids = batch.column("id")
            for rows_at, x in matrices(batch):
                fitted = shipped.value[x.shape[1]]
                k = len(fitted.values)
                if not k:
                    continue
                w, away = fitted.whitened(x)
                squares = (away * away).sum(axis=1)
                sums = [int(s) if int(s) <= _LONG else None for s in squares]
                hidden = np.tile(~fitted.sound, len(x))
                n = len(x) * k
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.repeat(rows_at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(n, fitted.n, np.int64)), pa.array([s for s in sums for _ in range(k)], pa.int64()),
                    pa.array(w.ravel(), mask=hidden), pa.array(fitted.explained() * len(x), pa.float64()),
                    pa.array([fitted.identity_error] * n, pa.float64())], schema=schema)

    return ship(rows).mapInArrow(run, out).withColumnRenamed("id", key)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Fit on the distinct whole vectors of a table and project all its rows."""
    return transform(df, fit(df, key, vector, count, scale), key, vector, scale)
