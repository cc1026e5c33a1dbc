"""Additive explanations of class-1 scores."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelake.session import cut_lineage

# Rows whose products are held at a time.
EXPLAINED_AT_ONCE = 2048


def top_contributions(contributions: Column, n: int | None = 5) -> Column:
    """First ``n`` (feature, contribution) structs by magnitude, ties by name; all when n is None."""
    def by_size(a: Column, b: Column) -> Column:
        x, y = F.abs(a["contribution"]), F.abs(b["contribution"])
        return (F.when(x > y, -1).when(x < y, 1)
                .when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0))

    ranked = F.array_sort(contributions, by_size)
    return ranked if n is None else F.slice(ranked, 1, n)


def linear_contributions(df: DataFrame, coefficients: Mapping[str, float], means: Mapping[str, float]) -> Column:
    """coef * (x - mean) per feature, on the log-odds scale; the base value is the score at the means."""
    return F.array(*[
        F.struct(F.lit(c).alias("feature"),
                 F.round(F.lit(float(w)) * (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(float(means[c]))),
                         4).alias("contribution"))
        for c, w in coefficients.items()])


def feature_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in columns]).first()
    return row.asDict()


# -- tree ensembles ------------------------------------------------------------------------------


@dataclass
class Tree:
    """Node arrays of one tree: a row with ``x[feature] <= limit`` goes left; leaves have left = -1.

    ``share`` is the part of its parent's training rows that came to a node.
    """

    feature: list[int]
    limit: list[float]
    left: list[int]
    right: list[int]
    share: list[float]
    value: list[float]


def tree_nodes(spark: SparkSession, saved_model: str, boosted: bool = False) -> list[Tree]:
    """Node arrays of a saved tree model, leaf values scaled so that the trees add up to the model.

    Their size is set by tree count and depth, never by the data.
    """
    nodes = spark.read.parquet(f"{saved_model}/data").select("treeID", "nodeData.*").collect()
    weights = {}
    if boosted:
        trees_of = spark.read.parquet(f"{saved_model}/treesMetadata").toDF("treeID", "metadata", "weight")
        weights = {r["treeID"]: r["weight"] for r in trees_of.select("treeID", "weight").collect()}
    by_tree: dict[int, dict[int, object]] = {}
    for n in nodes:
        by_tree.setdefault(n["treeID"], {})[n["id"]] = n
    trees = []
    for tree, by_id in sorted(by_tree.items()):
        scale = weights[tree] if boosted else 1.0 / len(by_tree)
        ids = sorted(by_id)
        if ids != list(range(len(ids))):
            raise ValueError("node ids are not consecutive")
        out = Tree([], [], [], [], [1.0] * len(ids), [])
        cover = [float(by_id[i]["rawCount"]) if boosted else float(sum(by_id[i]["impurityStats"])) for i in ids]
        for i in ids:
            node, split = by_id[i], by_id[i]["split"]
            inner = node["leftChild"] >= 0
            if inner and split["numCategories"] != -1:
                raise ValueError("categorical splits are not explained")
            stats = node["impurityStats"]
            out.feature.append(split["featureIndex"] if inner else -1)
            out.limit.append(split["leftCategoriesOrThreshold"][0] if inner else 0.0)
            out.left.append(node["leftChild"] if inner else -1)
            out.right.append(node["rightChild"] if inner else -1)
            out.value.append(scale * (node["prediction"] if boosted else stats[1] / sum(stats)))
            if inner:
                for child in (node["leftChild"], node["rightChild"]):
                    out.share[child] = cover[child] / cover[i]
        trees.append(out)
    return trees


def most_features(tree: Tree) -> int:
    """Most features that one path of a tree asks."""
    def below(node: int, seen: frozenset) -> int:
        if tree.left[node] < 0:
            return len(seen)
        seen = seen | {tree.feature[node]}
        return max(below(tree.left[node], seen), below(tree.right[node], seen))

    return below(0, frozenset())


def expected_value(tree: Tree) -> float:
    """Mean of the leaf values by the training rows that came to them."""
    def below(node: int) -> float:
        if tree.left[node] < 0:
            return tree.value[node]
        return sum(tree.share[c] * below(c) for c in (tree.left[node], tree.right[node]))

    return below(0)


def tree_values(tree: Tree, x, phi) -> None:
    """Add the Shapley values of one tree for all rows of ``x`` (features by rows) to ``phi``.

    On a path a known feature lets a row through (1) or not (0), an unknown one counts with its share z. Averaging over all
    orders of features is the integral over t of the product of the terms z(1 - t) + o t, without the feature's own;
    Gauss-Legendre nodes evaluate it exactly. One walk over the tree extends the product by one term per edge on the way
    down and adds up leaf value times product on the way up; at each edge the sum below, with the edge's term unwound, is
    what its feature contributes. An edge that narrows a feature asked before replaces that one's term, and takes back what the
    upper edge counts for the same leaves. So the work is nodes x rows x integration nodes, however many features there are.
    """
    import numpy as np

    points, weights = np.polynomial.legendre.leggauss(most_features(tree) // 2 + 1)
    t, w = (points + 1) / 2, weights / 2
    rows = x.shape[1]

    def term(z: float, met):
        """The term, and its reciprocal weighted for the integral, for every integration node and row."""
        no, yes = z * (1 - t), z * (1 - t) + t
        return np.where(met, yes[:, None], no[:, None]), np.where(met, (w / yes)[:, None], (w / no)[:, None])

    def walk(node: int, product, asked: dict):
        if tree.left[node] < 0:
            return tree.value[node] * product
        f = tree.feature[node]
        goes_left = x[f] <= tree.limit[node]
        z, met, unwound = asked.get(f, (1.0, None, None))
        rest = product if unwound is None else product * unwound / w[:, None]
        total = None
        for child, passes in ((tree.left[node], goes_left), (tree.right[node], ~goes_left)):
            share = z * tree.share[child]
            here = passes if met is None else passes & met
            extended, reciprocal = term(share, here)
            below = walk(child, rest * extended, {**asked, f: (share, here, reciprocal)})
            phi[f] += np.einsum("qr,qr->r", below, reciprocal) * (here - share)
            if unwound is not None:
                phi[f] -= np.einsum("qr,qr->r", below, unwound) * (met - z)
            total = below if total is None else total + below
        return total

    walk(0, np.ones((len(t), rows)), {})


def tree_contributions(df: DataFrame, trees: Sequence[Tree], names: Sequence[str], key: str, features: str = "features") -> DataFrame:
    """Shapley values per row under path-dependent expectations: (key, base_value, contributions).

    Rows that no limit of the trees tells apart lie in one cell and share their values: each cell is explained once, however many
    rows it holds, ``EXPLAINED_AT_ONCE`` cells at a time, and the rows find their values by a join. Spark's trees have fewer
    limits per feature than bins, so with few features there are few cells. The trees travel as a broadcast variable.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    shipped = spark.sparkContext.broadcast(list(trees))
    labels = list(names)
    place_out = f"`{key}` {df.schema[key].dataType.simpleString()}, __cell binary"
    out = "__cell binary, base_value double, contributions array<struct<feature: string, contribution: double>>"
    place_schema, schema = (to_arrow_schema(spark.createDataFrame([], s).schema) for s in (place_out, out))

    def limits() -> list:
        import numpy as np

        return [np.unique([v for tree in shipped.value for g, v in zip(tree.feature, tree.limit) if g == f]) for f in range(len(labels))]

    def place(batches: Iterator) -> Iterator:
        """A cell is the number of limits below the value, for each feature."""
        import numpy as np
        import pyarrow as pa

        bounds = limits()
        for batch in batches:
            n = len(batch)
            x = np.asarray(batch.column("x").flatten()).reshape(n, len(labels)) if n else np.zeros((0, len(labels)))
            cells = np.stack([np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(bounds)], axis=1).astype("<i4")
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * len(labels)), n, [None, pa.py_buffer(cells.tobytes())])
            columns = [batch.column(0), packed.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, place_schema)], schema=place_schema)

    def explain(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        base = sum(map(expected_value, shipped.value))
        # A cell's upper limit goes the way of all its values; above the last limit, as for NaN, no comparison holds.
        corners = [np.append(b, np.nan) for b in limits()]
        for batch in batches:
            n = len(batch)
            cells = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4").reshape(n, len(labels))
            x = np.stack([c[cells[:, f]] for f, c in enumerate(corners)])
            phi = np.zeros(x.shape)
            for a in range(0, n, EXPLAINED_AT_ONCE):
                part = np.ascontiguousarray(x[:, a:a + EXPLAINED_AT_ONCE])
                for tree in shipped.value:
                    tree_values(tree, part, phi[:, a:a + EXPLAINED_AT_ONCE])
            values = pa.array(phi.T.ravel())
            parts = pa.StructArray.from_arrays([pa.array(labels * n, pa.string()), values], names=["feature", "contribution"])
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * len(labels))
            columns = [batch.column(0), pa.array(np.full(n, base)), pa.ListArray.from_arrays(offsets, parts).cast(schema.field(2).type)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    placed = cut_lineage(df.select(key, vector_to_array(F.col(features)).alias("x")).mapInArrow(place, place_out))
    # Explaining is work for all cores, however little room the cells take. By column Spark would leave this step out, as the
    # distinct cells lie in that order already, and then put the small partitions together.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    explained = placed.select("__cell").distinct().repartition(tasks).mapInArrow(explain, out)
    return placed.join(explained, "__cell").select(key, "base_value", "contributions")
